"""One record from the records of a conversation's chunks, with a recap in chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Limits, connecting phrases and section titles of the recap.
LIMITS = {"important_facts": 24, "decisions": 20, "open_questions": 16, "goals": 12, "next_steps": 12}
MAX_WORDS, MAX_CHARS = 600, 4200
INSIGHT_BRIDGES = ("Building on that", "The thread also established", "Another line of thought emphasized", "Later discussion reinforced")
DECISION_BRIDGES = ("They also chose", "Another decision was", "The thread further settled on")
TITLES = (
    "What the discussion was about", "How the discussion evolved over time", "Key insights discovered",
    "Decisions that were made", "Remaining open questions", "Current direction of work",
)


def cut(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut between words, with an ellipsis."""
    bare = T.collapse(text)
    head = F.substring(bare, 1, most - 1)
    whole = F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*\z", "")).otherwise(head)
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(F.regexp_replace(whole, r"[.,;:\- ]+\z", ""), F.lit("…")))


def cut_words(text: Column, most: Column) -> Column:
    own = T.words(text)
    short = F.regexp_replace(F.array_join(F.slice(own, F.lit(1), F.greatest(most, F.lit(1))), " "), r"[.,;:\- ]+\z", "")
    return F.when(F.size(own) <= most, F.array_join(own, " ")).otherwise(F.concat(short, F.lit("…")))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit("[a-z0-9]+"))


def without_parts(text: Column) -> Column:
    return T.collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\[Part\s+\d+/\d+\]", ""))


def first_sentence(text: Column, most: int = 280) -> Column:
    bare = without_parts(text)
    own = F.regexp_extract(bare, r"(?s)\A(.*?[.!?](?:\s+|\z))", 1)
    return F.when((own != "") & (F.length(own) <= most), T.strip(own)).otherwise(cut(bare, most))


def soften(text: Column) -> Column:
    """A sentence as a clause: no leading article or narration, no stop, lower-case start unless an acronym."""
    out = F.regexp_replace(T.collapse(text), r"[.!?]+\z", "")
    out = F.regexp_replace(out, r"(?i)\A(the|a|an)\s+", "")
    out = F.regexp_replace(out, r"(?i)\A(segment|part|discussion|chunk)\s+\d+\s+(explored|focused on|addressed|covered)\s+", "")
    out = F.regexp_replace(out, r"(?i)\Athe conversation (focused on|explored|addressed|centered on)\s+", "")
    acronym = out.rlike(r"\A(\p{Lu}\p{Lu}|\p{Lu}[^\p{L}]|\p{Lu}\z)")
    return F.when(out.rlike(r"\A\p{Lu}") & ~acronym, F.concat(F.lower(F.substring(out, 1, 1)), F.substr(out, F.lit(2)))).otherwise(out)


def gist(text: Column, most: int = 220) -> Column:
    own = soften(first_sentence(text, most))
    return F.when(own != "", own).otherwise(soften(cut(text, most)))


def diverse(items: Column, limit: int) -> Column:
    """The first ``limit`` items that no earlier kept one nearly repeats."""
    keyed = F.transform(F.filter(F.transform(items, T.collapse), lambda x: x != ""), lambda x: F.struct(T.norm_key(x).alias("k"), T.content_tokens(x).alias("t"), x.alias("v")))

    def same(a: Column, b: Column) -> Column:
        return F.when((F.size(a["t"]) == 0) | (F.size(b["t"]) == 0), a["k"] == b["k"]).otherwise(T.jaccard(a["t"], b["t"]) >= 0.55)

    return F.slice(F.transform(T.keep_first(keyed, same), lambda p: p["v"]), 1, limit)


def newest_first(chunks: Column, name: str, limit: int) -> Column:
    """The last record's items, then the earlier ones in order."""
    last = F.element_at(chunks, -1)[name]
    earlier = F.flatten(F.transform(F.slice(chunks, F.lit(1), F.size(chunks) - 1), lambda c: c[name]))
    return T.distinct_by_key(F.concat(last, earlier), limit)


def _join(*parts: Column) -> Column:
    """Concatenation that reads null as nothing."""
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def _about() -> Column:
    topic, opening = T.collapse(F.col("topic")), F.col("_opening")
    goal, themes = F.col("_goal"), F.col("_themes")
    lead = (
        F.when(topic != "", F.concat(F.lit("This discussion revisited "), topic, F.lit(". If you have not looked at this thread in months, the through-line was how the pieces fit together, not a loose collection of notes.")))
        .when(goal != "", F.concat(F.lit("This discussion centered on "), goal, F.lit(".")))
        .when(opening != "", F.concat(F.lit("This discussion opened around "), gist(opening), F.lit(".")))
        .otherwise(F.lit("This discussion explored a technical problem from first principles."))
    )
    framing = F.when((opening != "") & (topic != "") & (T.norm_key(opening) != T.norm_key(topic)), F.concat(F.lit(" Early framing highlighted "), gist(opening), F.lit(".")))
    both = F.when(F.size(themes) > 1, F.concat(F.lit(" and "), soften(F.get(themes, F.lit(1)))))
    more = F.when(F.size(themes) > 0, _join(F.lit(" The conversation kept returning to the idea that "), soften(F.get(themes, F.lit(0))), both, F.lit(", which tied the later work together."))).when(
        (goal != "") & (topic != "") & (T.norm_key(goal) != T.norm_key(topic)), F.concat(F.lit(" The practical anchor throughout was "), goal, F.lit("."))
    )
    return _join(lead, framing, more)


def _evolution() -> Column:
    opening, tail, goal, topic = F.col("_opening"), F.col("_tail"), F.col("_goal"), F.col("topic")
    single = (
        F.when(opening != "", F.concat(F.lit("The exchange stayed focused on "), soften(opening)))
        .when(goal != "", F.concat(F.lit("Work stayed oriented toward "), goal, F.lit(".")))
        .otherwise(F.lit("The exchange moved in a single continuous arc without major topic shifts."))
    )
    begin = F.when(opening != "", F.concat(F.lit("The conversation began by examining "), soften(opening))).otherwise(F.lit("The conversation began with foundational definitions and constraints"))
    toward = (
        F.when((tail != "") & (T.norm_key(tail) != T.norm_key(opening)), F.concat(F.lit(", gradually tightening toward "), soften(tail)))
        .when(goal != "", F.concat(F.lit(", gradually tightening toward "), goal))
        .when(topic != "", F.concat(F.lit(", gradually tightening around "), soften(topic)))
    )
    end = F.lit(". Along the way, earlier exploratory ideas were tested against later constraints, so the thread reads as refinement rather than repetition.")
    many = _join(begin, F.concat(F.lit(" and unfolded across "), F.col("n").cast("string"), F.lit(" segments rather than one sitting")), toward, end)
    return F.when(F.col("n") <= 1, single).otherwise(many)


def _bridged(items: Column, bridges: tuple[str, ...], form) -> Column:
    phrase = F.array(*[F.lit(b) for b in bridges])
    return F.transform(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), lambda x, i: form(F.get(phrase, F.least(i, F.lit(len(bridges) - 1))), soften(x)))


def _insights() -> Column:
    own = F.col("_insights")
    rest = F.array_join(_bridged(own, INSIGHT_BRIDGES, lambda b, x: F.concat(F.lit(" "), b, F.lit(", "), x, F.lit("."))), "")
    text = F.concat(F.lit("Several insights emerged, including "), soften(F.get(own, F.lit(0))), F.lit("."), rest, F.lit(" Taken together, these insights explain why later choices felt necessary rather than arbitrary."))
    return F.when(F.size(own) == 0, F.lit("No single breakthrough dominated; understanding accumulated through linked observations.")).otherwise(text)


def _decisions() -> Column:
    own = F.col("_decided")
    lead = F.concat(F.lit("The group committed to "), soften(F.get(own, F.lit(0))), F.lit("."))
    rest = F.array_join(F.concat(F.array(lead), _bridged(own, DECISION_BRIDGES, lambda b, x: F.concat(b, F.lit(" "), x))), ". ")
    many = F.concat(rest, F.lit(". These choices narrowed the design space for what followed."))
    return (
        F.when(F.size(own) == 0, F.lit("No firm decisions were recorded, though the direction of travel became clearer as constraints surfaced."))
        .when(F.size(own) == 1, lead).otherwise(many)
    )


def _questions() -> Column:
    own = F.col("_asked")
    first = F.array_join(F.transform(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), soften), "; ")
    many = F.concat(F.lit("Important questions remain, including "), first, F.lit("; and "), soften(F.element_at(own, -1)), F.lit(". Answering these will determine how complete the eventual solution can be."))
    return (
        F.when(F.size(own) == 0, F.lit("No major open questions were left on the table at the end of the thread."))
        .when(F.size(own) == 1, F.concat(F.lit("One question still needs resolution: "), soften(F.get(own, F.lit(0))), F.lit("."))).otherwise(many)
    )


def _direction() -> Column:
    goal, tail, steps = F.col("_goal"), F.col("_tail"), F.col("_steps")
    step = lambda i: soften(F.get(steps, F.lit(i)))
    focus = F.when(goal != "", F.concat(F.lit("Current work is focused on "), goal, F.lit("."))).when(tail != "", F.concat(F.lit("Current work is focused on "), soften(tail), F.lit(".")))
    move = F.when(F.size(steps) == 1, F.concat(F.lit("The immediate next move is to "), step(0), F.lit("."))).when(
        F.size(steps) > 1, F.concat(F.lit("The immediate next moves are to "), step(0), F.lit(" and then "), step(1), F.lit("."))
    ).when((tail != "") & (goal == ""), F.concat(F.lit("The thread ended pointed toward "), soften(tail), F.lit(".")))
    parts = F.array_compact(F.array(focus, move))
    return F.when(F.size(parts) == 0, F.lit("The thread ended with exploratory momentum but no single named next action.")).otherwise(
        F.concat(F.array_join(parts, " "), F.lit(" That is the handoff point if you are picking this work back up."))
    )


def fitted(blocks: Column) -> Column:
    """Sections {title, body} joined; while they are too long, the bodies of all but the last two
    lose eight words a round, twelve rounds at most; then the text is cut."""
    whole = lambda b: F.array_join(F.transform(b, lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["body"])), "\n\n")
    fits = lambda b: (token_count(whole(b)) <= MAX_WORDS) & (F.length(whole(b)) <= MAX_CHARS)

    def shorten(b: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            n = token_count(x["body"])
            body = F.when((i < F.size(b) - 2) & (n > 28), cut_words(x["body"], F.greatest(F.lit(20), n - 8))).otherwise(x["body"])
            return F.struct(x["title"].alias("title"), body.alias("body"))

        return F.transform(b, one)

    tight = F.aggregate(F.sequence(F.lit(1), F.lit(12)), blocks, lambda b, _: F.when(fits(b), b).otherwise(shorten(b)))
    return F.get(F.transform(F.array(tight), lambda b: F.when(fits(b), whole(b)).otherwise(cut(whole(b), MAX_CHARS))), F.lit(0))


def merge(records: DataFrame) -> DataFrame:
    """conv, topic, the merged lists, summary, parse_ok, chunks of every conversation."""
    lists, clean = tuple(LIMITS), lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.strip), lambda x: x != "")
    item = F.struct(F.col("chunk_index").cast("int").alias("idx"), *[clean(F.col(n)).alias(n) for n in lists], T.strip(F.coalesce("topic", F.lit(""))).alias("topic"), F.coalesce("summary", F.lit("")).alias("summary"))
    rows = records.groupBy("conv").agg(F.array_sort(F.collect_list(item)).alias("chunks"), F.every("parse_ok").alias("parse_ok"))
    c = F.col("chunks")
    topics = F.filter(F.transform(c, lambda x: x["topic"]), lambda t: t != "")
    rows = rows.withColumn("n", F.size(c)).withColumn("topic", F.coalesce(F.when(F.size(topics) > 0, F.element_at(topics, -1)), F.lit("")))
    for name in ("important_facts", "decisions", "open_questions"):
        rows = rows.withColumn(name, T.distinct_by_key(F.flatten(F.transform(c, lambda x: x[name])), LIMITS[name]))
    for name in ("goals", "next_steps"):
        rows = rows.withColumn(name, newest_first(c, name, LIMITS[name]))
    rows = rows.withColumn("_open", without_parts(F.get(c, F.lit(0))["summary"])).withColumn("_end", without_parts(F.element_at(c, -1)["summary"]))
    rows = rows.withColumn("_opening", gist(F.col("_open"))).withColumn("_tail", gist(F.col("_end"))).withColumn("_goal", F.coalesce(soften(F.get("goals", F.lit(0))), F.lit("")))
    picked = {"_themes": diverse(F.col("important_facts"), 2), "_insights": diverse(F.col("important_facts"), 4), "_decided": diverse(F.col("decisions"), 4), "_asked": diverse(F.slice("open_questions", F.greatest(F.lit(1), F.size("open_questions") - 7), 8), 4), "_steps": diverse(F.col("next_steps"), 2)}
    rows = rows.withColumns(picked)
    bodies = (_about(), _evolution(), _insights(), _decisions(), _questions(), _direction())
    rows = rows.withColumn("_blocks", F.array(*[F.struct(F.lit(t).alias("title"), T.collapse(b).alias("body")) for t, b in zip(TITLES, bodies, strict=True)]))
    one = F.when(F.col("_end") != "", F.col("_end")).otherwise(F.col("_open"))
    summary = F.when((F.col("n") <= 1) & (one != ""), cut(one, MAX_CHARS)).otherwise(fitted(F.col("_blocks")))
    return rows.select("conv", F.col("n").alias("chunks"), "topic", *lists, summary.alias("summary"), "parse_ok")
