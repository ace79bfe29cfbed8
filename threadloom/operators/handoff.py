"""Handing one record on: the plain block, the short briefing, the sized briefing, and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import voice as V
from . import state as S

# Role hints in their order, default sentences, prompt texts.
ROLE_HINTS = (
    (r"(?i)\btutor|teaching|lesson|course|explains?\b", "Tutor continuing a learning session"),
    (r"(?i)\bburnout|journal|personal|regret|stagnation\b", "Coach continuing a personal reflection"),
    (r"(?i)\bproject manager|roadmap|scope creep|retrospective|sprint\b", "Advisor continuing a project thread"),
    (r"(?i)\bgithub|issue|pull request|kubernetes|CVE\b", "Engineer continuing a technical discussion"),
    (r"(?i)\breddit|post|commenter|thread\b", "Facilitator continuing a community thread"),
)
MIN_WORDS, MAX_WORDS = 120, 180
PROMPT = "You are continuing an interrupted work session.\n\nYou have NO prior context except this checkpoint briefing.\n\n{briefing}\n\nContinue the work.\nDo not ask for the original conversation.\n"
CONTINUE = {
    "coding": "Continue the implementation. Propose the specific next code change and explain why.",
    "tutorials": "Continue as my tutor. What is the next lesson step and exercise?",
    "research": "Continue the research thread. What is the next question or experiment?",
    "project_planning": "Continue as PM. What is the next action for the team?",
    "debugging": "Continue debugging. What is the next diagnostic step?",
    "architecture": "Continue the design discussion. What decision or spike is next?",
}
CONTINUE_OTHER = "Continue the work from where this briefing left off. Be specific and actionable."
TITLE = "# AI Handoff Briefing"
LISTS = ("objective", "completed_work", "active_problems", "resolved_problems", "constraints", "next_steps", "open_questions", "goals", "important_facts")


def _voiced(text: Column) -> Column:
    return T.let(text, lambda t: F.when(T.contains_any(F.lower(t), S.OBSERVED), V.clean_lines(t)).otherwise(t))


def _section(title: str, items: Column, most: int) -> Column:
    body = F.array_join(F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n## {title}\n"), body))


def _prepared(records: DataFrame) -> DataFrame:
    """Records with cleaned fields as c_<name>."""
    clean = {f"c_{n}": V.clean_items(F.col(n)) for n in LISTS}
    clean |= {f"c_{n}": V.clean_voice(F.col(n)) for n in ("current_state", "continuation_context", "topic")}
    clean["c_summary"] = V.clean_summary(F.col("summary"))
    return records.withColumns(clean)


def short_briefing(records: DataFrame) -> DataFrame:
    """``records`` with briefing: role, position, work, next action; empty where nothing is known."""
    c = F.col
    rows = _prepared(records)
    cur, ctx = c("c_current_state"), c("c_continuation_context")
    said = F.concat_ws(" ", F.coalesce("current_state", F.lit("")), F.coalesce("continuation_context", F.lit("")), F.array_join("objective", " "))
    role = F.coalesce(*[F.when(said.rlike(p), F.lit(r)) for p, r in ROLE_HINTS], F.when(F.size("objective") > 0, F.lit("Assistant continuing an active task")), F.lit("Assistant continuing the prior conversation"))
    begins = lambda a, b: a.startswith(F.substring(b, 1, 120))
    both = (
        F.when(F.lower(F.substring(cur, 1, 100)) == F.lower(F.substring(ctx, 1, 100)), cur).when(begins(ctx, cur), ctx).when(begins(cur, ctx), cur)
        .when(~ctx.contains(cur) & ~cur.contains(ctx), F.concat(cur, F.lit(" "), ctx)).otherwise(cur)
    )
    position = F.when((cur != "") & (ctx != ""), both).when(cur != "", cur).otherwise(ctx)
    # only the leads that name a step count here
    named = F.when(F.lower(ctx).rlike("the next step would be to |the next actionable step is to |the next step is to |next: "), V.next_from_text(ctx))
    step = F.when((ctx != "") & (cur != "") & (ctx != cur), F.coalesce(F.nullif(named, F.lit("")), F.when(F.length(ctx) > F.length(cur) + 20, ctx)))
    problem = F.get("active_problems", F.lit(0))
    action = F.coalesce(step, F.get("objective", F.lit(0)), F.when(problem.isNotNull(), F.concat(F.lit("Address: "), problem)), F.lit("Pick up from the current position and ask what to do next."))
    parts = [
        F.lit(f"{TITLE}\n\nContinue the conversation from where it stopped. Use only the context below.\n\n## Role"), role, F.lit("\n## Current position"),
        F.when(position != "", position).otherwise(F.lit("No explicit position captured.")), _section("Completed work", c("c_completed_work"), 8), _section("Open problems", c("c_active_problems"), 8),
        _section("Recently resolved", c("c_resolved_problems"), 6), _section("Constraints", c("c_constraints"), 6), F.lit("\n## Next action"), action,
    ]
    known = (cur != "") | (ctx != "") | (F.size("objective") > 0) | (F.size("completed_work") > 0) | (F.size("active_problems") > 0)
    text = _voiced(F.concat_ws("\n", *parts))
    return rows.withColumn("briefing", F.when(known, text).otherwise(F.lit(""))).select(*records.columns, "briefing")


def _fewer(text: Column, most: int) -> Column:
    own = T.words(text)
    return F.when(F.size(own) <= most, T.strip(text)).otherwise(F.concat(F.regexp_replace(F.array_join(F.slice(own, 1, most), " "), r"[.,;]+\z", ""), F.lit("…")))


def _total(sections: Column) -> Column:
    lists = F.concat(sections["completed"], sections["open"], sections["constraints"], sections["resolved"])
    return T.word_count(sections["position"]) + T.word_count(sections["action"]) + F.aggregate(lists, F.lit(0), lambda n, x: n + T.word_count(x))


def _fill(sections: Column, items: Column, grow) -> Column:
    """A fold that adds items while the sections hold too few words."""
    return F.aggregate(items, sections, lambda s, x: F.when(_total(s) >= MIN_WORDS, s).otherwise(grow(s, x)))


def _with(s: Column, **fields: Column) -> Column:
    return F.struct(*[fields.get(n, s[n]).alias(n) for n in ("position", "action", "completed", "open", "resolved", "constraints")])


def sized_briefing(records: DataFrame) -> DataFrame:
    """``records`` (with archetype) with briefing: padded from summary, facts and constraints to 120
    words where it is shorter, its position trimmed where it is longer than 180."""
    c = F.col
    rows = _prepared(records)
    cur, ctx, summary, topic = c("c_current_state"), c("c_continuation_context"), c("c_summary"), c("c_topic")
    key = F.lower(T.strip(F.coalesce("archetype", F.lit("mixed"))))
    base = F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in S.ROLES.items()], F.lit(S.ROLES["mixed"]))
    own_topic = T.strip(F.coalesce("topic", F.lit("")))
    role = F.when((own_topic != "") & (F.length(own_topic) < 80), F.concat(base, F.lit(" — continue on: "), own_topic)).otherwise(F.concat(base, F.lit(" — continue the prior conversation from the exact stopping point")))

    merged = F.array_join(V.distinct_sentences(F.concat(T.sentences(cur), T.sentences(ctx))), " ")
    position = F.coalesce(F.nullif(merged, F.lit("")), F.nullif(V.clean_summary(summary), F.lit("")), F.when(topic != "", F.concat(F.lit("The session covers "), V.without_stop(topic), F.lit("."))), F.lit(""))
    rows = rows.withColumn("_place", position)
    default = F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in S.FALLBACKS.items()], F.lit(S.FALLBACKS["mixed"]))
    told = F.array(*[V.next_from_text(x) for x in (ctx, cur, summary)])
    address = F.transform("c_active_problems", lambda p: F.when(F.lower(p).rlike("^(resolve|address|fix|answer)"), p).otherwise(F.concat(F.lit("Address: "), p)))
    answer = F.transform("c_open_questions", lambda q: F.concat(F.lit("Answer: "), q))
    nk, mk = T.norm_key(ctx), T.norm_key(cur)
    beyond = (ctx != "") & (cur != "") & (F.length(nk) > F.length(mk) + 25) & ~nk.startswith(F.substring(mk, 1, 80))
    rest = F.when(nk.contains(mk), F.regexp_replace(F.substr(ctx, F.position(F.substring(mk, 1, 40), F.lower(ctx)) + F.length(mk)), r"^[ ,.]+|[ ,.]+$", "")).otherwise(ctx)
    tail = F.when(beyond & (F.length(rest) > 20), F.array(V.capital(rest))).otherwise(F.array().cast("array<string>"))
    options = F.transform(F.concat(told, c("c_objective"), address, c("c_next_steps"), answer, tail, F.array(default)), V.clean_voice)
    place = c("_place")
    # the keys of the position and its sentences are made once, not once an option
    spoken = F.transform(F.concat(F.array(place), T.sentences(place)), T.norm_key)
    apart = lambda x, keys: T.let(T.norm_key(x), lambda k: ~F.exists(keys, lambda s: T.overlap_keys(k, s)))
    open_ = T.let(spoken, lambda keys: F.filter(options, lambda x: (F.length(x) >= 10) & apart(x, keys)))
    action = V.without_stop(F.coalesce(F.get(open_, F.lit(0)), default))
    told_once = lambda n, most: F.slice(V.distinct_sentences(c(n)), 1, most)
    start = F.struct(
        place.alias("position"), action.alias("action"), told_once("c_completed_work", 8).alias("completed"), told_once("c_active_problems", 8).alias("open"),
        told_once("c_resolved_problems", 6).alias("resolved"), told_once("c_constraints", 6).alias("constraints"),
    )
    rows = rows.withColumn("_s", start)
    say = lambda s, x: F.when(s["position"] == "", x).otherwise(F.concat(s["position"], F.lit(" "), x))
    rows = rows.withColumn("_s", _fill(c("_s"), V.distinct_sentences(T.sentences(summary)), lambda s, x: F.when(T.sentence_overlap(x, s["position"]), s).otherwise(_with(s, position=say(s, x)))))
    known = lambda s, x: F.exists(F.concat(s["completed"], F.array(s["position"])), lambda y: T.sentence_overlap(x, y))
    more = F.concat("c_completed_work", "c_important_facts")
    rows = rows.withColumn("_s", _fill(c("_s"), more, lambda s, x: F.when(known(s, x), s).otherwise(_with(s, completed=F.concat(s["completed"], F.array(x))))))
    rows = rows.withColumn("_s", _fill(c("_s"), c("c_constraints"), lambda s, x: F.when(F.array_contains(s["constraints"], x), s).otherwise(_with(s, constraints=F.concat(s["constraints"], F.array(x))))))

    s = c("_s")
    short = lambda items, n: F.transform(items, lambda x: _fewer(x, n))

    def whole(place: Column) -> Column:
        return F.concat_ws(
            "\n", F.lit(f"{TITLE}\n\nYou are picking up an in-progress conversation. Continue naturally — do not recap for a human audience.\n\n## Role"), role, F.lit("\n## Current position"), place,
            _section("Completed work", short(s["completed"], 35), 8), _section("Open problems", short(s["open"], 35), 8), _section("Recently resolved", short(s["resolved"], 30), 6),
            _section("Constraints", short(s["constraints"], 30), 6), F.lit("\n## Next action"), s["action"],
        )

    shown = F.when(s["position"] != "", _fewer(s["position"], 90)).otherwise(F.lit("Session stopped mid-thread; infer context from completed work and next action."))
    rows = rows.withColumn("_text", whole(shown))
    over = T.word_count(c("_text")) - MAX_WORDS
    n = T.word_count(s["position"])
    # a position that was cut to 90 words already is no longer found whole, and stays
    trimmed = F.concat(F.regexp_replace(F.array_join(F.slice(T.words(s["position"]), F.lit(1), F.greatest(F.lit(30), n - over)), " "), r"[.,;]+\z", ""), F.lit("…"))
    text = F.when((over > 0) & (n > 40) & (n <= 90), whole(trimmed)).otherwise(c("_text"))
    full = reduce(lambda a, b: a | b, [F.size(n_) > 0 for n_ in ("objective", "completed_work", "active_problems", "next_steps", "open_questions")], (cur != "") | (ctx != "") | (topic != "") | (summary != ""))
    return rows.withColumn("briefing", F.when(full, _voiced(text)).otherwise(F.lit(""))).select(*records.columns, "briefing")


def plain_block() -> Column:
    """A record's fields as a labelled block."""
    c = F.col
    line = lambda title, n: F.when(F.coalesce(c(n), F.lit("")) != "", F.concat(F.lit(f"**{title}:** "), c(n), F.lit("\n")))

    def items(title: str, n: str, most: int = 1 << 20) -> Column:
        body = F.array_join(F.transform(F.slice(c(n), 1, most), lambda x: F.concat(F.lit("- "), x)), "\n")
        return F.when(F.size(n) > 0, F.concat(F.lit(f"**{title}:**\n"), body, F.lit("\n")))

    return T.strip(F.concat_ws(
        "\n", F.lit("# AI Handoff Context\n"), line("Topic", "topic"), line("Summary", "summary"), items("Objectives", "objective"), line("Current state", "current_state"),
        items("Completed work", "completed_work"), items("Active problems", "active_problems"), items("Resolved problems", "resolved_problems"), items("Constraints", "constraints"),
        line("Continuation context", "continuation_context"), items("Important facts", "important_facts", 12), items("Goals", "goals"), items("Open questions", "open_questions"), items("Decisions", "decisions"), items("Next steps", "next_steps"),
    ))


def hand_over(records: DataFrame, version: str = "auto") -> DataFrame:
    """``records`` with handoff: ``v1`` the plain block, ``v2`` the short and ``v3`` (auto) the sized briefing;
    the plain block where a briefing is empty."""
    if version == "v1":
        return records.withColumn("handoff", plain_block())
    made = short_briefing(records) if version == "v2" else sized_briefing(records)
    return made.withColumn("handoff", F.coalesce(F.nullif("briefing", F.lit("")), plain_block())).drop("briefing")


def prompt(briefing: Column, category: Column) -> Column:
    before, after = PROMPT.split("{briefing}")
    closing = F.coalesce(*[F.when(category == k, F.lit(v)) for k, v in CONTINUE.items()], F.lit(CONTINUE_OTHER))
    return F.concat(F.lit(before), T.strip(briefing), F.lit(after), F.lit("\n"), closing, F.lit("\n"))


def _quoted(value: Column) -> Column:
    block = F.concat(F.lit("|\n"), F.array_join(F.transform(F.split(value, "\n"), lambda x: F.concat(F.lit("  "), x)), "\n"), F.lit("\n"))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    odd = value.rlike(r"[\[\]{},&*#?|\-<>=!%@`]") | (value != T.strip(value))
    return F.when(value == "", F.lit('""')).when(value.contains("\n") | value.contains(":") | value.rlike(r"^[-#|>]"), block).when(odd, quoted).otherwise(value)


def flat_yaml() -> Column:
    """A state's seven fields as the flat YAML of version 1."""
    one = lambda n: F.concat(F.lit(f"{n}: "), _quoted(F.coalesce(n, F.lit(""))))

    def many(n: str) -> Column:
        rows = F.array_join(F.transform(n, lambda x: F.concat(F.lit("  - "), _quoted(x))), "\n")
        return F.when(F.size(n) > 0, F.concat(F.lit(f"{n}:\n"), rows)).otherwise(F.lit(f"{n}: []"))

    lines = F.concat_ws("\n", one("project"), many("objective"), one("current_state"), many("completed_work"), many("active_problems"), many("constraints"), one("next_action"))
    return F.concat(F.regexp_replace(lines, r"\s+\z", ""), F.lit("\n"))
