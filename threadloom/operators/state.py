"""From chunk records to the state of a conversation and the texts that hand it on.

One shuffle gathers a conversation's records (tens of small structs); every
rule is then a Column over their ordered array. Narrow clean-up of phrases
happens before it, on chunk rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import voice as V

# Phrases and default texts of the state rules.
CLOSURE = r"(?i)(start a new chat|start new chat|that makes sense|thank you|thanks\.|i'?ll (?:work on )?implement|continue (?:my )?(?:web development )?course from|thread is resolved|conversation stopped)"
COURSE = r"(?i)continue (?:my )?(?:web development )?course from\s+([^\n\.]+)"
PIVOT = r"(?i)(?:as this chat|how to speed up|growing bigger|becoming slow|different topic|change (?:of )?topic|side question)"
OFFER = r"(?i)If you want(?: next)?, I can(?: next)?(?: explain| show you| give you)[:\s]+([^\n]+)"
QUIZ = ("member saved", "what will data contain", "what the data contains after", "save.php")
GOALS = ("objective", "goals", "open_questions", "next_steps")
ROLES = {
    "tutorial": "Tutor", "debugging": "Engineer", "project_management": "Project Lead", "journal": "Coach",
    "research": "Research Assistant", "github": "Engineer", "reddit": "Facilitator", "mixed": "Assistant",
}
FALLBACKS = {
    "tutorial": "Resume teaching from the current lesson point: explain the next concept, check understanding with one question, then assign a short exercise.",
    "debugging": "Continue diagnosing from the last known symptom: propose the next check, interpret results, and narrow the root cause.",
    "project_management": "Pick up the open project thread: summarize blockers, propose the next decision, and ask what resource or approval is needed.",
    "journal": "Continue the reflection with one focused question about what they want to change, accept, or explore next — then listen.",
    "research": "Continue synthesizing: state the open hypothesis, propose the next source or experiment, and list what evidence would resolve uncertainty.",
    "github": "Continue the technical thread: address the open issue or question directly and propose a concrete fix, workaround, or next diagnostic step.",
    "reddit": "Continue the community thread: respond to the latest question, offer one practical next step, and ask what constraint matters most.",
    "mixed": "Continue from the current stopping point: restate what is unfinished and take the next concrete step in the conversation.",
}
OBSERVED = ("the slice", "the discussion is focused", "the participant")
NO_OBJECTIVE = "Continue the in-progress work from the current position."
NO_POSITION = "Conversation stopped mid-thread; use completed work and next action below."
LISTS = ("objective", "goals", "open_questions", "next_steps", "completed_work", "active_problems", "resolved_problems", "constraints", "important_facts", "decisions")
TEXTS = ("topic", "summary", "current_state", "continuation_context")


def band(n: Column) -> Column:
    """Size of the frontier: a fifth of the chunks, 2 to 5."""
    return F.when(n <= 0, F.lit(0)).otherwise(F.greatest(F.lit(2), F.least(F.lit(5), F.ceil(n * F.lit(0.2))))).cast("int")


def cleaned(records: DataFrame, *keep: str) -> DataFrame:
    """conv, chunk_index and the record's fields without voice and repeats; narrow."""
    return records.select("conv", "chunk_index", *keep, *[V.clean_items(F.col(c)).alias(c) for c in LISTS], *[(F.coalesce(c, F.lit("")) if c == "summary" else V.clean_voice(F.col(c))).alias(c) for c in TEXTS])


def gathered(records: DataFrame) -> DataFrame:
    """conv, chunks (ordered records with cleaned fields), n."""
    item = F.struct(F.col("chunk_index").cast("int").alias("idx"), *LISTS, *TEXTS)
    return cleaned(records).groupBy("conv").agg(F.array_sort(F.collect_list(item)).alias("chunks"), (F.max("chunk_index") + 1).cast("int").alias("n"))


def distinct_told(chunks: Column, name: str) -> Column:
    """A list field over all chunks in order: items of 8 characters and more that tell something new."""
    return T.told_once(F.filter(F.flatten(F.transform(chunks, lambda c: c[name])), lambda x: F.length(x) >= 8))


def _tail(n: int) -> Column:
    return F.right(F.col("conversation"), F.lit(n))


def _last(text: Column, what: str) -> Column:
    """Where the last ``what`` begins, from 0; -1 if there is none."""
    return F.when(text.contains(what), F.length(text) - F.locate(what[::-1], F.reverse(text)) - (len(what) - 1)).otherwise(F.lit(-1))


def signals(rows: DataFrame) -> DataFrame:
    """What the transcript's end says, as columns _closed, _hint_next, _hint_position, _pivot, _quiz_words, _moved_on."""
    last = F.col("terminal")
    said = F.concat_ws(" ", last["current_state"], last["continuation_context"], last["summary"], last["topic"])
    # parts of the transcript that several rules read are columns of their own, so that each is cut once
    rows = rows.withColumns({"_end": F.right(T.strip(F.col("conversation")), F.lit(5000)), "_late": _tail(8000), "_recent": F.lower(_tail(6000))})
    end, late, recent = F.col("_end"), F.col("_late"), F.col("_recent")
    course = V.without_stop(V.clean_voice(F.regexp_extract(end, COURSE, 1)))
    thanks = end.rlike(r"(?i)that makes sense\.?\s*thank you")
    offers = F.regexp_extract_all(end, F.lit(OFFER), F.lit(1))
    offer = V.without_stop(V.clean_voice(F.regexp_replace(F.element_at(offers, -1), r"^[ .]+|[ .]+$", "")))
    has_course = end.rlike(COURSE)
    hint = (
        F.when(thanks, F.lit("Implement mentor suggestions: PR validation vs push/merge deployment flow."))
        .when(has_course, F.concat(F.lit("Continue the course from "), course, F.lit(".")))
        .when(end.rlike(PIVOT) & F.lower(end).contains("fetch"), F.lit("Continue the web development course from Fetch API (AJAX)."))
        .when((F.size(offers) > 0) & (offer != ""), F.concat(F.lit("Pick up from tutor offer: "), offer, F.lit(".")))
    )
    place = F.when(thanks, F.lit("Thread resolved — implement the agreed CI/CD workflow changes.")).when(
        has_course, F.concat(F.lit("Learner should resume the tutorial from "), course, F.lit(" (prior lessons through Event Handling are complete)."))
    )
    before = F.regexp_extract(late, rf"(?s)\A(.*?){PIVOT.replace('(?i)', '(?i:', 1)})", 1)
    asked = F.greatest(_last(late, "?"), T.let(F.lower(late), lambda low: _last(low, "what do you think")))
    told = F.struct(asked.alias("asked"), F.length(before).alias("until"))
    region = T.let(told, lambda p: F.when((p["asked"] >= 0) & (p["until"] > p["asked"]), F.substr(late, p["asked"] + 1, p["until"] - p["asked"])))
    words = F.filter(T.words(F.lower(F.coalesce(region, F.lit("")))), lambda w: F.length(w) > 5)
    moved = recent.rlike(PIVOT) | (recent.contains("continue") & recent.contains("fetch")) | F.col("conversation").rlike(COURSE)
    return rows.withColumns({"_closed": said.rlike(CLOSURE) | _tail(4000).rlike(CLOSURE), "_hint_next": hint, "_hint_position": place, "_pivot": late.rlike(PIVOT), "_quiz_words": words, "_moved_on": moved})


def stale(item: Column) -> Column:
    """A quiz question that the conversation has left behind."""
    return F.col("_moved_on") & T.contains_any(T.norm_key(item), QUIZ)


def superseded(item: Column) -> Column:
    left = lambda key: F.exists("_quiz_words", lambda w: key.contains(w)) | (F.col("_moved_on") & T.contains_any(key, QUIZ))
    return F.col("_pivot") & T.let(T.norm_key(item), left)


def open_problems(chunks: Column) -> Column:
    """Active problems of the frontier that are neither stale nor superseded nor told twice."""
    kept = F.filter(distinct_told(chunks, "active_problems"), lambda x: ~(F.col("_closed") & stale(x)) & ~superseded(x))
    return kept


def unresolved(problems: Column, resolved: Column) -> Column:
    """The problems that no resolved one tells."""
    apart = lambda keys: F.filter(problems, lambda a: T.let(T.norm_key(a), lambda k: ~F.exists(keys, lambda r: T.overlap_keys(k, r))))
    return T.let(F.transform(resolved, T.norm_key), apart)


def _apart(text: Column) -> Column:
    """Whether a text tells something else than the position, whose key is ``_place``."""
    return (F.col("_position") == "") | ~T.let(T.norm_key(text), lambda k: T.overlap_keys(k, F.col("_place")))


def build(records: DataFrame, transcripts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The state of every conversation, with the columns that ``keep`` names (chunks, label, archetype).

    ``records``: conv, chunk_index and the record's fields. ``transcripts``: conv,
    conversation, label, archetype.
    """
    return build_gathered(gathered(records), transcripts, keep)


def build_gathered(rows: DataFrame, transcripts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``build`` from rows of ``gathered``, or of a merged partial state."""
    rows = rows.join(transcripts.select("conv", F.coalesce("conversation", F.lit("")).alias("conversation"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("archetype", F.lit("mixed")).alias("archetype")), "conv")
    cutoff = F.greatest(F.lit(0), F.col("n") - band(F.col("n")))
    rows = rows.withColumn("cutoff", cutoff).withColumn("_front", F.filter("chunks", lambda c: c["idx"] >= F.col("cutoff")))
    rows = rows.withColumn("frontier", F.when(F.size("_front") > 0, F.col("_front")).otherwise(F.slice("chunks", -1, 1))).withColumn("history", F.filter("chunks", lambda c: c["idx"] < F.col("cutoff")))
    rows = signals(rows.withColumn("terminal", F.element_at("frontier", -1)).drop("_front"))
    last = F.col("terminal")
    rows = rows.withColumn("completed_work", distinct_told(F.col("chunks"), "completed_work")).withColumn("constraints", distinct_told(F.col("chunks"), "constraints"))
    rows = rows.withColumn("_position", F.coalesce("_hint_position", V.position(last["current_state"], last["continuation_context"], last["summary"], last["topic"]))).withColumn("_place", T.norm_key(F.col("_position")))
    rows = rows.withColumn("_resolved", distinct_told(F.col("frontier"), "resolved_problems")).withColumn("_open", open_problems(F.col("frontier")))
    rows = rows.withColumn("active_problems", unresolved(F.col("_open"), F.col("_resolved")))

    lead = F.concat(
        F.filter(F.array(last["topic"]), lambda t: (t != "") & ~stale(t)),
        F.filter(F.concat(*[last[g] for g in GOALS]), lambda t: ~stale(t)),
        F.flatten(F.transform(F.reverse("frontier"), lambda c: c["objective"])),
    )
    rows = rows.withColumn("_lead", F.array_distinct(lead))
    themes = F.flatten(F.transform("history", lambda c: F.concat(c["objective"], F.filter(F.array(c["topic"]), lambda t: t != ""))))
    rows = rows.withColumn("_themes", F.array_except(F.array_distinct(themes), F.col("_lead")))
    bullet = lambda x: F.concat(F.lit("- "), x)
    lines = F.concat(F.slice("_lead", 1, 1), F.transform(F.slice("_lead", 2, 3), bullet), F.transform(F.slice("_themes", 1, 3), bullet))
    nothing = (F.size("_lead") == 0) & (F.size("_themes") == 0)
    rows = rows.withColumn("objective_display", F.when(nothing, F.lit(NO_OBJECTIVE)).otherwise(F.array_join(lines, "\n")))
    items = F.transform(F.filter(F.transform(F.split("objective_display", "\n"), T.strip), lambda s: s != ""), lambda s: F.when(s.startswith("- "), T.strip(F.substr(s, F.lit(3)))).otherwise(s))

    rows = rows.withColumn("next_action", next_action())
    title = F.coalesce(F.nullif(T.strip(F.col("label")), F.lit("")), F.nullif(F.element_at("chunks", -1)["topic"], F.lit("")), F.lit("Assistant continuation"))
    latest = F.when(F.size("completed_work") > 0, F.concat(F.lit("Work in progress. Latest completed: "), F.element_at("completed_work", -1)))
    current = F.coalesce(F.nullif("_position", F.lit("")), latest, F.lit(NO_POSITION))
    return rows.select(
        "conv", "n", "cutoff", F.col("label").alias("project"), title.alias("project_title"), items.alias("objective"), "objective_display", current.alias("current_state"),
        "completed_work", "active_problems", "constraints", "next_action", F.col("_closed").alias("closed"), *keep,
    )


def _starts(text: Column, leads: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("^(" + "|".join(leads) + ")")


def next_action() -> Column:
    """The first that applies of: the transcript's hint, the newest open step or goal of the frontier,
    its open problems, what its last context says comes next, then the same without the
    frontier's conditions, then the archetype's default."""
    last = F.col("terminal")
    newest = lambda names: F.flatten(F.transform(F.reverse("frontier"), lambda c: F.concat(*[F.reverse(c[n]) for n in names])))
    first = lambda items, keep: F.get(F.filter(items, keep), F.lit(0))
    step = first(newest(("next_steps", "goals", "open_questions", "objective")), lambda x: (F.length(x) >= 10) & ~stale(x) & ~superseded(x) & _apart(x))
    named = lambda x, leads: F.when(_starts(x, leads), x).otherwise(F.concat(F.lit("Address: "), x))
    problem = first(F.transform("_open", lambda x: named(x, ("continue", "address", "resolve", "fix"))), _apart)
    told = T.let(V.next_from_text(last["continuation_context"]), lambda t: F.when((t != "") & ~stale(t) & _apart(t), t))
    return F.coalesce(*[V.without_stop(x) for x in (F.col("_hint_next"), step, problem, told)], derived(F.col("frontier")))


def derived(chunks: Column) -> Column:
    """The next action from records alone: newest open problem, newest goal, what the last context
    adds to the last state, the archetype's default; each apart from ``_position``."""
    last = F.element_at(chunks, -1)
    newest = lambda names: F.flatten(F.transform(F.reverse(chunks), lambda c: F.concat(*[F.reverse(c[n]) for n in names])))
    first = lambda items, keep: F.get(F.filter(items, keep), F.lit(0))
    named = lambda x: F.when(_starts(x, ("resolve", "address", "fix", "answer")), x).otherwise(F.concat(F.lit("Address: "), x))
    problem = first(F.transform(newest(("active_problems",)), named), _apart)
    goal = first(newest(GOALS), lambda x: (F.length(x) >= 10) & _apart(x))
    context, now = last["continuation_context"], last["current_state"]
    nk, mk = T.norm_key(context), T.norm_key(now)
    at = F.position(F.lower(F.substring(now, 1, 40)), F.lower(context))
    rest = F.regexp_replace(F.substr(context, at + F.length(now)), r"^[ ,.]+|[ ,.]+$", "")
    added = F.when((now != "") & (F.length(nk) > F.length(mk) + 20) & nk.contains(mk) & (at > 0) & (F.length(rest) > 15), V.capital(rest))
    tail = F.coalesce(T.full(V.next_from_text(context)), added, F.when(F.length(context) > 30, F.element_at(T.sentences(context), -1)), F.nullif(context, F.lit("")))
    tail = T.let(tail, lambda t: F.when(_apart(t), t))
    default = F.coalesce(*[F.when(F.lower(T.strip(F.col("archetype"))) == k, F.lit(v)) for k, v in FALLBACKS.items()], F.lit(FALLBACKS["mixed"]))
    return F.coalesce(*[V.without_stop(x) for x in (problem, goal, tail)], default)


def build_whole(records: DataFrame, labels: DataFrame) -> DataFrame:
    """The state of a conversation with all its chunks alike, its transcript unread: the older form.

    ``labels``: conv, label, archetype. The columns are those that ``briefing`` needs.
    """
    return build_whole_gathered(gathered(records), labels)


def build_whole_gathered(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``build_whole`` from rows of ``gathered``."""
    rows = rows.join(labels.select("conv", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("archetype", F.lit("mixed")).alias("archetype")), "conv")
    last = F.element_at("chunks", -1)
    for name in ("objective", "completed_work", "constraints"):
        rows = rows.withColumn(name, distinct_told(F.col("chunks"), name))
    rows = rows.withColumn("_open", distinct_told(F.col("chunks"), "active_problems")).withColumn("_resolved", distinct_told(F.col("chunks"), "resolved_problems"))
    rows = rows.withColumn("active_problems", unresolved(F.col("_open"), F.col("_resolved")))
    latest = F.when(F.size("completed_work") > 0, F.concat(F.lit("Work in progress. Latest completed: "), F.element_at("completed_work", -1)))
    place = V.position(last["current_state"], last["continuation_context"], last["summary"], last["topic"])
    rows = rows.withColumn("_position", F.coalesce(T.full(place), latest, F.lit(""))).withColumn("_place", T.norm_key(F.col("_position")))
    goals = F.when(F.size("objective") == 1, F.get("objective", F.lit(0))).when(F.size("objective") > 1, bullets(F.slice("objective", 1, 12))).when(last["topic"] != "", last["topic"]).otherwise(F.lit(NO_OBJECTIVE))
    title = F.coalesce(F.nullif(T.strip(F.col("label")), F.lit("")), F.nullif(last["topic"], F.lit("")), F.lit("Assistant continuation"))
    return rows.select(
        "conv", "n", title.alias("project_title"), "objective", goals.alias("objective_display"), F.coalesce(F.nullif("_position", F.lit("")), F.lit(NO_POSITION)).alias("current_state"),
        "completed_work", "active_problems", "constraints", derived(F.col("chunks")).alias("next_action"),
    )


def bullets(items: Column) -> Column:
    return F.when(F.size(items) == 0, F.lit("None identified.")).otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def briefing() -> Column:
    """The briefing text, from the columns of ``build``."""
    c = F.col
    parts = [
        F.lit("## PROJECT\n"), F.concat(c("project_title"), F.lit("\n")), F.lit("Objective:"), F.concat(c("objective_display"), F.lit("\n")),
        F.lit("Current Position:"), F.concat(c("current_state"), F.lit("\n")), F.lit("Completed Work:"), F.concat(bullets(c("completed_work")), F.lit("\n")),
        F.lit("Active Problems:"), F.concat(bullets(c("active_problems")), F.lit("\n")), F.lit("Constraints:"), F.concat(bullets(c("constraints")), F.lit("\n")),
        F.lit("Next Action:"), c("next_action"),
    ]
    return T.let(T.strip(F.concat_ws("\n", *parts)), lambda text: F.when(T.contains_any(F.lower(text), OBSERVED), V.clean_lines(text)).otherwise(text))


def exports(text: Column, label: Column) -> dict[str, Column]:
    """The briefing wrapped for each platform; empty where it is empty."""
    t, named = T.strip(F.coalesce(text, F.lit(""))), F.coalesce(label, F.lit("")) != ""
    beside = lambda before, after: F.when(named, F.concat(F.lit(before), label, F.lit(after))).otherwise(F.lit(""))
    out = {
        "claude": F.concat(
            F.lit("Continue this conversation"), beside(" (", ")"),
            F.lit(". Treat the briefing below as your only prior context.\nDo not summarize for the user — continue naturally from the stopping point.\n\n"), t,
        ),
        "chatgpt": F.concat(
            F.lit("# Conversation handoff"), beside(" — ", ""),
            F.lit("\n\nPaste into a new ChatGPT thread. Continue from where the prior conversation stopped.\n\n"), t,
            F.lit("\n\n---\nPlease continue the conversation from the current position."),
        ),
        "gemini": F.concat(
            F.lit("You are picking up an in-progress conversation"), beside(" for: ", ""),
            F.lit(".\nUse this briefing as your context and continue without recapping for a human audience.\n\n"), t,
        ),
        "markdown": F.concat(beside("# AI Handoff — ", "\n\n"), t),
    }
    return {k: F.when(t == "", F.lit("")).otherwise(v) for k, v in out.items()}
