"""The explanation of a conversation: overview, topics, learnings, status, questions, takeaways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import voice as V
from . import state as S

# Leads of observer phrases, and default overviews.
OBSERVED = r"(?i)^(the (?:slice|discussion|participant|session|conversation)|this (?:slice|discussion|session)|the user is|they have been)"
OVERVIEWS = {
    "tutorial": "This conversation followed a structured learning or tutorial session.",
    "debugging": "This conversation focused on diagnosing and resolving a technical problem.",
    "project_management": "This conversation tracked project progress, decisions, and blockers.",
    "journal": "This conversation was a reflective or personal journal-style discussion.",
    "research": "This conversation explored research questions and synthesized findings.",
    "github": "This conversation centered on a technical issue, code review, or open-source thread.",
    "reddit": "This conversation was a community discussion with multiple perspectives.",
    "mixed": "This conversation covered several related topics over time.",
}
PAUSE = "The conversation reached a natural pause point without a sharp unresolved blocker."


def observed(text: Column) -> Column:
    return T.blank(text) | text.rlike(OBSERVED)


def topic_label(text: Column) -> Column:
    short = lambda bare: F.when(F.length(bare) > 90, F.concat(F.regexp_replace(F.substring(bare, 1, 87), r"[ ,;]+\z", ""), F.lit("…"))).otherwise(bare)
    return T.let(F.regexp_replace(V.clean_voice(text), r"(?i)^(topic|objective|goal)\s*:\s*", ""), short)


def told_once(items: Column) -> Column:
    return T.told_once(items)


def _plain(items: Column, least: int = 1) -> Column:
    return F.filter(items, lambda x: ~observed(x) & (F.length(x) >= least))


def explain(records: DataFrame, labels: DataFrame) -> DataFrame:
    """conv, explanation and its parts. ``records`` as for the state; ``labels``: conv, label, archetype."""
    named = labels.select("conv", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("archetype", F.lit("mixed")).alias("archetype"))
    return told(S.gathered(records).join(named, "conv")).select("conv", "explanation", "overview", "topics", "learnings", "questions", "takeaways", "status")


def told(rows: DataFrame) -> DataFrame:
    """Rows of gathered chunks with label and archetype, with the explanation beside what they hold."""
    names = rows.columns
    rows = rows.withColumn("terminal", F.element_at("chunks", -1))
    for name in S.LISTS:
        rows = rows.withColumn(f"_{name}", S.distinct_told(F.col("chunks"), name))
    labels_ = F.flatten(F.transform("chunks", lambda c: F.transform(F.concat(F.array(c["topic"]), c["objective"]), topic_label)))
    rows = rows.withColumn("topics", F.slice(told_once(_plain(labels_)), 1, 14))
    rows = rows.withColumn("_summaries", told_once(_plain(F.transform("chunks", lambda c: V.clean_summary(c["summary"])), 20)))
    unlearned = lambda x: F.when(F.lower(x).startswith("learned "), F.substr(x, F.lit(9))).otherwise(x)
    learned = F.concat("_completed_work", "_decisions", "_resolved_problems", "_goals")
    rows = rows.withColumn("learnings", F.slice(told_once(F.transform(_plain(learned), unlearned)), 1, 12))
    problem = F.transform(_plain(F.col("_active_problems")), lambda x: F.when(x.endswith("?"), x).otherwise(F.concat(F.lit("Unresolved: "), V.without_stop(x))))
    rows = rows.withColumn("questions", F.slice(told_once(F.concat(_plain(F.col("_open_questions")), problem, _plain(F.col("_goals")))), 1, 10))
    facts = _plain(F.concat("_important_facts", "_completed_work", "_constraints", "_resolved_problems"), 12)
    threads = F.transform(F.slice("topics", 1, 4), lambda t: F.concat(F.lit("Major thread: "), V.without_stop(t)))
    rows = rows.withColumn("takeaways", F.slice(told_once(F.concat(facts, threads, F.slice("learnings", 1, 3))), 1, 8))

    last = F.col("terminal")
    rows = rows.withColumn("_own", V.clean_summary(last["summary"])).withColumn("_stands", V.position(last["current_state"], last["continuation_context"], last["summary"], last["topic"]))
    own, place = F.col("_own"), F.col("_stands")
    covered = F.when(F.size("topics") == 1, F.concat(F.lit("This conversation focused on "), V.without_stop(F.get("topics", F.lit(0))), F.lit("."))).when(
        F.size("topics") > 1, F.concat(F.lit("This conversation covered "), V.without_stop(F.array_join(F.slice("topics", 1, 4), ", ")), F.lit("."))
    )
    default = F.coalesce(*[F.when(F.col("archetype") == k, F.lit(v)) for k, v in OVERVIEWS.items()], F.lit(OVERVIEWS["mixed"]))
    rows = rows.withColumn("_opening", F.coalesce(F.when((F.length(own) > 40) & ~observed(own), own), F.get("_summaries", F.lit(0)), covered, default))
    lead = F.col("_opening")
    named = F.when((F.col("label") != "") & ~F.lower(lead).contains(F.lower("label")), F.concat(V.without_stop(lead), F.lit(" ("), F.col("label"), F.lit(")."))).otherwise(lead)
    stop = lambda x: F.concat(V.without_stop(x), F.lit("."))
    context = last["continuation_context"]
    latest = lambda name, before: F.when(F.size(name) > 0, F.concat(F.lit(before), stop(F.element_at(name, -1))))
    status = F.coalesce(
        F.when(~observed(place), stop(place)), F.when((F.length(context) > 30) & ~observed(context), stop(context)),
        latest("_active_problems", "The conversation ended with open threads including "), latest("_completed_work", "Progress was made on "),
        latest("topics", "The latest focus was "), F.lit(PAUSE),
    )
    rows = rows.withColumn("overview", stop(named)).withColumn("status", status)
    parts = [("OVERVIEW", F.col("overview")), ("MAIN TOPICS", S.bullets(F.col("topics"))), ("LEARNINGS / DECISIONS", S.bullets(F.col("learnings"))), ("CURRENT STATUS", F.col("status")), ("OPEN QUESTIONS", S.bullets(F.col("questions"))), ("KEY TAKEAWAYS", S.bullets(F.col("takeaways")))]
    whole = T.strip(F.concat_ws("\n\n", *[x for title, body in parts for x in (F.lit(title), body)]))
    return rows.select(*names, whole.alias("explanation"), "overview", "topics", "learnings", "questions", "takeaways", "status")
