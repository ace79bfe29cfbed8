"""Conversations as checked input of the state rules: an extractor that reads records off a
turn's own words, transcripts whose ends say something, and the SQL that states what the
rules make of both.

The given conversations are invented prose in which no rule word occurs. So the
extractor fills the fields of a record by the turn's length and words, wraps its
JSON in the ways models do, and a conversation ends by its number in one of
nine ways (thanks, a course to go on with, an unanswered question, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import saliency as S
from ..functions import text as T
from ..functions import voice as V
from ..operators import explain, extraction, handoff, quality, recap, sparse, state
from ..session import table
from .conversations import TOKENS, TURNS, _score_sql, turns

CREATED = "2024-01-01T00:00:00+00:00"
LISTS, SCALARS = extraction.LISTS, extraction.SCALARS

#: What a conversation's transcript ends with, by conv % 9.
ENDINGS = (
    "",
    "That makes sense. Thank you",
    "Please continue my web development course from Arrays and Loops. Bye",
    "Do you see why? It was the shared table thing. Different topic please",
    "If you want, I can explain: how closures keep names.\nok",
    "As this chat is growing bigger let us fetch more",
    "Right? So what do you think about the shared thing, really. A side question here",
    "All done, thanks.",
    "Now the conversation stopped",
)
QUIZ = "what will data contain after save.php runs"
#: The fields by turn: (field, ((modulus of the length, remainder, items), ...)); an item is literal text,
#: with {a:b} for b words from word a on and {g} for conv % 7.
LIST_RULES = (
    ("important_facts", ((1, 0, ("{1:6}",)), (2, 1, ("Fact {3:5}",)))),
    ("goals", ((6, 0, ("Goal {3:4}",)), (6, 3, (QUIZ,)))),
    ("decisions", ((5, 2, ("Decided on {1:4}", "Decided on {1:4}")),)),
    ("next_steps", ((8, 2, ("Next {2:5}",)),)),
    ("open_questions", ((7, 1, ("Why {1:3}?", "How about {5:3}?")),)),
    ("objective", ((5, 0, ("Objective {1:3}", "The discussion covers {2:2}")), (5, 1, ("Finish the shared goal of the thread", "{2:4}")))),
    ("completed_work", ((3, 1, ("Done {1:3}", "Setup of the shared base tables is done")), (3, 2, ("setup of  the shared BASE tables is done", "tiny", "The participant has finished {4:3}")), (16, 5, ("Finished {1:50}", "Also finished {30:50}", "Further {20:40}")))),
    ("active_problems", ((4, 1, ("Lock of the shared table {g} is stuck",)), (4, 3, (QUIZ, "Trouble with {1:3}")), (4, 2, ("The learner is stuck?", "{2:3}", "Fix the order of {3:2}")))),
    ("resolved_problems", ((5, 3, ("lock of the SHARED table {g} is stuck",)), (5, 4, ("Something small about {1:2}",)))),
    ("constraints", ((9, 0, ("Never touch {1:2} again",)), (3, 2, ("Keep it small and simple, always",)))),
)
SCALAR_RULES = {
    "topic": ((7, 6, ""), (1, 0, "{1:4}")),
    "summary": ((5, 4, ""), (5, 3, "{1:40}"), (1, 0, "The slice discusses {2:8}.")),
    "current_state": ((16, 5, "{1:70}."), (4, 0, ""), (4, 1, "The participant is at {1:5}. {3:6}."), (4, 2, "{1:6}"), (1, 0, "Now {1:5}.")),
    "continuation_context": ((3, 0, ""), (6, 1, "The next step is to {4:5}."), (6, 4, "{1:6} and then {2:9}"), (1, 0, "Now {1:5}. Later on {6:9}!")),
}


def phrase(template: str) -> Column:
    """A template's text from columns _w (the turn's words) and conv, trimmed."""
    parts = []
    for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
        if piece == "{g}":
            parts.append(F.pmod("conv", F.lit(7)).cast("string"))
        elif piece.startswith("{"):
            a, b = map(int, piece[1:-1].split(":"))
            parts.append(F.array_join(F.slice("_w", a, b), " "))
        elif piece:
            parts.append(F.lit(piece))
    return T.strip(F.concat(*parts)) if parts else F.lit("")


def cued(chunks: DataFrame) -> DataFrame:
    """An extractor: chunk rows with ``raw``, the JSON of what the rules above read off the text."""
    rows = chunks.withColumn("_w", T.words(F.col("chunk"))).withColumn("_n", F.length("chunk"))
    hit = lambda m, r: F.pmod("_n", F.lit(m)) == r
    empty = F.array().cast("array<string>")
    fields = {n: F.concat(*[F.when(hit(m, r), F.array(*map(phrase, items))).otherwise(empty) for m, r, items in rules]) for n, rules in LIST_RULES}
    for n, rules in SCALAR_RULES.items():
        fields[n] = F.coalesce(*[F.when(hit(m, r), phrase(text)) for m, r, text in rules])
    order = [*SCALARS[:2], *LISTS, *SCALARS[2:]]
    older = {"goals": "current_goals", "decisions": "attempted_solutions", "topic": "active_issue", "important_facts": "key_entities"}
    single = {"objective": "objective", "open_questions": "current_blocker"}
    told_ = rows.withColumns({f"_{n}": fields[n] for n in order})
    plain = F.to_json(F.struct(*[F.col(f"_{n}").alias(n) for n in order]))
    aliased = F.to_json(F.struct(*[(F.get(f"_{n}", F.lit(0)) if n in single else F.col(f"_{n}")).alias(single.get(n) or older.get(n, n)) for n in order]))
    form, p = F.pmod(F.col("conv") + F.col("chunk_index"), F.lit(8)), F.col("_p")
    written = told_.withColumn("_p", F.when(form == 5, aliased).otherwise(plain)).drop(*[f"_{n}" for n in order])
    raw = (
        F.when(form == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("Here it is: "), F.regexp_replace(p, r"\}\z", ", }"), F.lit(" Done.")))
        .when(form == 3, F.regexp_replace(p, r'"\}\z', ""))  # cut within the last field
        .when(form == 4, F.lit("There is no record in this answer."))
        .otherwise(p)
    )
    return written.withColumn("raw", raw).drop("_w", "_n", "_p")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("conv", F.col("idx").cast("int").alias("chunk_index"), F.col("text").alias("chunk"))
    return extraction.extract(rows, extractor=cued)


def archetype() -> Column:
    kinds = list(state.FALLBACKS)
    return F.get(F.array(*map(F.lit, kinds)), F.pmod("conv", F.lit(len(kinds))).cast("int"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv, conversation with its ending, label, archetype, path, created_at."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("conv")).agg(ordered.alias("t"))
    kind = F.pmod("conv", F.lit(9))
    ending = F.coalesce(*[F.when(kind == i, F.lit(e and f"\n\n{e}")) for i, e in enumerate(ENDINGS)])
    text = F.concat(F.array_join(F.transform("t", lambda t: t["text"]), "\n\n"), ending)
    label = F.when(F.pmod("conv", F.lit(11)) == 0, F.lit("")).otherwise(F.concat(F.lit("conversation "), "conv"))
    return rows.select("conv", text.alias("conversation"), label.alias("label"), archetype().alias("archetype"), F.lit("").alias("path"), F.lit(CREATED).alias("created_at"))


# ---- the same in SQL ----


def q(text: str) -> str:
    """A SQL literal."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def key(x: str) -> str:
    return collapse(f"lower({x})")


def overlap(a: str, b: str) -> str:
    """Of two keys."""
    within = f"CASE WHEN length({a}) <= length({b}) THEN length({a}) >= 40 AND contains({b}, {a}) ELSE length({b}) >= 40 AND contains({a}, {b}) END"
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR left({a}, 80) = left({b}, 80) OR {within}))"


def told_alike(a: str, b: str) -> str:
    return overlap(key(a), key(b))


def keep_first(items: str, same=told_alike) -> str:
    """Items that ``same`` finds in no item kept before."""
    test = same("k", "x[1]")
    return f"list_reduce(list_transform({items}, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {test})) > 0 THEN acc ELSE list_concat(acc, x) END, []::VARCHAR[])"


def java(pattern: str) -> str:
    """A pattern as a SQL literal; the patterns used are alike in both dialects."""
    return q(pattern)


def replaced(x: str, rules) -> str:
    return reduce(lambda s, r: f"regexp_replace({s}, {java(r[0])}, {q(r[1].replace('$', chr(92)))}, 'g')", rules, x)


def voice(x: str) -> str:
    return collapse(replaced(strip(x), V.OBSERVER))


def clean_summary(x: str) -> str:
    return strip(replaced(voice(x), V.SUMMARY_LEADS))


def clean_items(x: str) -> str:
    return f"list_filter(list_transform(list_filter({x}, lambda i: {strip('i')} <> ''), lambda i: {voice('i')}), lambda i: i <> '')"


def without_stop(x: str) -> str:
    return f"rtrim({x}, '.')"


def upper(x: str) -> str:
    """In capitals, where a sharp s is two letters."""
    return f"replace(upper({x}), 'ẞ', 'SS')"


def capital(x: str) -> str:
    return f"{upper(f'left({x}, 1)')} || substr({x}, 2)"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({strip(x)}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '\S+')"


def distinct_sentences(items: str) -> str:
    return keep_first(f"list_filter(list_transform({items}, lambda s: {voice('s')}), lambda s: length(s) >= 12)")


def next_from_text(x: str) -> str:
    cases = []
    for lead in V.NEXT_LEADS:
        rest = without_stop(strip(f"substr({x}, position({q(lead)} IN lower({x})) + {len(lead)})"))
        cases.append(f"WHEN contains(lower({x}), {q(lead)}) AND {rest} <> '' THEN {capital(f'({rest})')}")
    return f"CASE {' '.join(cases)} ELSE '' END"


def position(state_: str, context: str, summary: str, topic: str) -> str:
    merged = f"array_to_string({distinct_sentences(f'list_concat({sentences(state_)}, {sentences(context)})')}, ' ')"
    return f"coalesce(nullif({merged}, ''), nullif({clean_summary(summary)}, ''), CASE WHEN {topic} <> '' THEN 'The session covers ' || {without_stop(topic)} || '.' END, '')"


def bullets(items: str) -> str:
    return f"CASE WHEN len({items}) = 0 THEN 'None identified.' ELSE array_to_string(list_transform({items}, lambda b: '- ' || b), chr(10)) END"


def first_of(items: str, keep: str) -> str:
    return f"list_filter({items}, lambda x: ({keep}))[1]"


def _phrase_sql(template: str) -> str:
    parts = []
    for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
        if piece == "{g}":
            parts.append("(conv % 7)::VARCHAR")
        elif piece.startswith("{"):
            a, b = map(int, piece[1:-1].split(":"))
            parts.append(f"array_to_string(w[{a}:{a + b - 1}], ' ')")
        elif piece:
            parts.append(q(piece))
    return strip("(" + " || ".join(parts) + ")") if parts else "''"


def _records_sql() -> str:
    """CTE rec: conv, i, n, and the fields of each regular record."""
    many = []
    for name, rules in LIST_RULES:
        items = [f"CASE WHEN len_ % {m} = {r} THEN [{', '.join(map(_phrase_sql, dict.fromkeys(texts)))}] ELSE [] END" for m, r, texts in rules]
        whole = reduce(lambda a, b: f"list_concat({a}, {b})", items)
        whole = f"list_filter({whole}, lambda x: x <> '')"
        if name in ("objective", "open_questions"):
            whole = f"CASE WHEN form = 5 THEN list_filter([({reduce(lambda a, b: f'list_concat({a}, {b})', items)})[1]], lambda x: x <> '') ELSE {whole} END"
        many.append(f"CASE WHEN form = 4 THEN []::VARCHAR[] ELSE {whole} END AS {name}")
    for name, rules in SCALAR_RULES.items():
        text = " ".join(f"WHEN len_ % {m} = {r} THEN {_phrase_sql(t)}" for m, r, t in rules)
        lost = "form IN (3, 4)" if name == "continuation_context" else "form = 4"
        many.append(f"CASE WHEN {lost} THEN '' {text} END AS {name}")
    return rf"""
{TURNS},
words AS (SELECT conv, idx AS i, text, length(text) AS len_, regexp_extract_all(text, '\S+') AS w, (conv + idx) % 8 AS form, count(*) OVER (PARTITION BY conv) AS n FROM turns),
rec AS (SELECT conv, i, n, text, form, {', '.join(many)} FROM words)"""


def _archetype_sql(conv: str) -> str:
    return f"[{', '.join(map(q, state.FALLBACKS))}][{conv} % {len(state.FALLBACKS)} + 1]"


def _sources_sql() -> str:
    endings = " ".join(f"WHEN conv_id % 9 = {i} THEN {q(chr(10) * 2 + e) if e else q('')}" for i, e in enumerate(ENDINGS))
    return f"""
src AS (SELECT conv_id AS conv, string_agg(text, chr(10) || chr(10) ORDER BY turn) || CASE {endings} END AS conversation,
        CASE WHEN conv_id % 11 = 0 THEN '' ELSE 'conversation ' || conv_id END AS label, {_archetype_sql('conv_id')} AS archetype
        FROM conversations GROUP BY conv_id)"""


RECORDS = _records_sql()
SOURCES = _sources_sql()
#: CTE cr: rec with cleaned fields.
CLEANED = "cr AS (SELECT conv, i, n, {} FROM rec)".format(", ".join([*[f"{clean_items(c)} AS {c}" for c in state.LISTS], *[f"{'summary' if c == 'summary' else voice(c)} AS {c}" for c in state.TEXTS]]))


def _stale(x: str) -> str:
    return "(moved AND (" + " OR ".join(f"contains({key(x)}, {q(m)})" for m in state.QUIZ) + "))"


def _superseded(x: str) -> str:
    return f"(turned AND (len(list_filter(quiz_words, lambda qw: contains({key(x)}, qw))) > 0 OR {_stale(x)}))"


def _last(text: str, what: str) -> str:
    return f"CASE WHEN contains({text}, {q(what)}) THEN length({text}) - position({q(what[::-1])} IN reverse({text})) - {len(what) - 1} ELSE -1 END"


def told(name: str, items: str) -> str:
    return keep_first(f"list_filter({items}, lambda x: length(x) >= 8)")


def _states_sql() -> str:
    """CTE st: the state of every conversation; CTE g: what is gathered of its records."""
    every = lambda c: f"coalesce(flatten(list({c} ORDER BY i)), []) AS a_{c}"
    front = lambda c: f"coalesce(flatten(list({c} ORDER BY i) FILTER (WHERE i >= cutoff)), []) AS f_{c}"
    newest = lambda names: "list_concat(" * (len(names) - 1) + f"list_reverse({names[0]})" + "".join(f", list_reverse({n}))" for n in names[1:])
    last = lambda c: f"arg_max({c}, i) AS l_{c}"
    goals = "list_concat(list_concat(list_concat(objective, goals), open_questions), next_steps)"
    apart = f"(place = '' OR NOT {told_alike('x', 'place')})"
    starts = lambda leads: "regexp_matches(lower(x), '^(" + "|".join(leads) + ")')"
    named = lambda items, leads: f"list_transform({items}, lambda x: CASE WHEN {starts(leads)} THEN x ELSE 'Address: ' || x END)"
    d_leads = ("resolve", "address", "fix", "answer")

    def derived(newest_problems: str, newest_goals: str) -> str:
        context, now = "l_continuation_context", "l_current_state"
        at = f"position(lower(left({now}, 40)) IN lower({context}))"
        rest = f"regexp_replace(substr({context}, {at} + length({now})), '^[ ,.]+|[ ,.]+$', '', 'g')"
        added = f"CASE WHEN {now} <> '' AND length({key(context)}) > length({key(now)}) + 20 AND contains({key(context)}, {key(now)}) AND {at} > 0 AND length({rest}) > 15 THEN {capital(f'({rest})')} END"
        tail = f"coalesce(nullif({next_from_text(context)}, ''), {added}, CASE WHEN length({context}) > 30 THEN ({sentences(context)})[-1] END, nullif({context}, ''))"
        tail = f"{first_of(f'[{tail}]', f'x IS NOT NULL AND {apart}')}"
        default = "CASE archetype " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in state.FALLBACKS.items()) + " END"
        options = [first_of(named(newest_problems, d_leads), apart), first_of(newest_goals, f"length(x) >= 10 AND {apart}"), tail]
        return f"coalesce({', '.join(map(without_stop, options))}, {default})"

    course = without_stop(voice(f"regexp_extract(tail5, {java(state.COURSE)}, 1)"))
    offer = without_stop(voice(f"regexp_replace(regexp_extract_all(tail5, {java(state.OFFER)}, 1)[-1], '^[ .]+|[ .]+$', '', 'g')"))
    pivot = state.PIVOT.replace("(?i)", "(?i:", 1) + ")"
    return f"""
{CLEANED},
cc AS (SELECT *, greatest(0, n - greatest(2, least(5, ceil(n * 0.2))))::BIGINT AS cutoff FROM cr),
g AS (SELECT conv, any_value(n) AS n, any_value(cutoff) AS cutoff, {', '.join(map(every, ('completed_work', 'constraints', 'objective', 'active_problems', 'resolved_problems')))},
      {', '.join(map(front, ('active_problems', 'resolved_problems')))}, {', '.join(map(last, (*state.TEXTS, *state.GOALS)))},
      arg_max({goals}, i) AS l_goal_items, coalesce(flatten(list(objective ORDER BY i DESC) FILTER (WHERE i >= cutoff)), []) AS f_objective_newest,
      coalesce(flatten(list({newest(('next_steps', 'goals', 'open_questions', 'objective'))} ORDER BY i DESC) FILTER (WHERE i >= cutoff)), []) AS f_steps,
      coalesce(flatten(list(list_reverse(active_problems) ORDER BY i DESC) FILTER (WHERE i >= cutoff)), []) AS f_problems, coalesce(flatten(list({newest(state.GOALS)} ORDER BY i DESC) FILTER (WHERE i >= cutoff)), []) AS f_goals,
      coalesce(flatten(list(list_reverse(active_problems) ORDER BY i DESC)), []) AS a_problems, coalesce(flatten(list({newest(state.GOALS)} ORDER BY i DESC)), []) AS a_goals,
      coalesce(flatten(list(list_concat(objective, CASE WHEN topic <> '' THEN [topic] ELSE [] END) ORDER BY i) FILTER (WHERE i < cutoff)), []) AS h_themes
      FROM cc GROUP BY conv),
t0 AS (SELECT *, right({strip('conversation')}, 5000) AS tail5, right(conversation, 8000) AS late, lower(right(conversation, 6000)) AS recent,
       concat_ws(' ', l_current_state, l_continuation_context, l_summary, l_topic) AS said FROM g JOIN src USING (conv)),
t1 AS (SELECT *, regexp_matches(said, {java(state.CLOSURE)}) OR regexp_matches(right(conversation, 4000), {java(state.CLOSURE)}) AS closed,
       regexp_matches(tail5, {java(r'(?i)that makes sense\.?\s*thank you')}) AS thanked, regexp_matches(tail5, {java(state.COURSE)}) AS has_course, {course} AS course, coalesce({offer}, '') AS offer,
       regexp_matches(late, {java(state.PIVOT)}) AS turned, regexp_extract(late, {java(f'(?s)^(.*?){pivot}')}, 1) AS before,
       greatest({_last('late', '?')}, {_last('lower(late)', 'what do you think')}) AS asked,
       regexp_matches(recent, {java(state.PIVOT)}) OR (contains(recent, 'continue') AND contains(recent, 'fetch')) OR regexp_matches(conversation, {java(state.COURSE)}) AS moved FROM t0),
t2 AS (SELECT *, list_filter({words("lower(coalesce(CASE WHEN asked >= 0 AND length(before) > asked THEN substr(late, asked + 1, length(before) - asked) END, ''))")}, lambda w: length(w) > 5) AS quiz_words,
       CASE WHEN thanked THEN 'Implement mentor suggestions: PR validation vs push/merge deployment flow.' WHEN has_course THEN 'Continue the course from ' || course || '.'
            WHEN regexp_matches(tail5, {java(state.PIVOT)}) AND contains(lower(tail5), 'fetch') THEN 'Continue the web development course from Fetch API (AJAX).'
            WHEN offer <> '' THEN 'Pick up from tutor offer: ' || offer || '.' END AS hint_next,
       CASE WHEN thanked THEN 'Thread resolved — implement the agreed CI/CD workflow changes.' WHEN has_course THEN 'Learner should resume the tutorial from ' || course || ' (prior lessons through Event Handling are complete).' END AS hint_place FROM t1),
t3 AS (SELECT *, {told('c', 'a_completed_work')} AS completed_work, {told('c', 'a_constraints')} AS constraints, {told('c', 'f_resolved_problems')} AS resolved,
       list_filter({told('c', 'f_active_problems')}, lambda x: (NOT (closed AND {_stale('x')}) AND NOT {_superseded('x')})) AS open_,
       {position('l_current_state', 'l_continuation_context', 'l_summary', 'l_topic')} AS own_place FROM t2),
t4 AS (SELECT *, coalesce(hint_place, own_place) AS place, list_filter(open_, lambda a: (len(list_filter(resolved, lambda r: {told_alike('a', 'r')})) = 0)) AS active_problems,
       list_concat(list_concat(list_filter([l_topic], lambda x: (x <> '' AND NOT {_stale('x')})), list_filter(l_goal_items, lambda x: (NOT {_stale('x')}))), f_objective_newest) AS lead0 FROM t3),
t5 AS (SELECT *, {keep_first('lead0', lambda a, b: f'{a} = {b}')} AS lead, list_filter({keep_first('h_themes', lambda a, b: f'{a} = {b}')}, lambda x: (NOT list_contains(lead0, x))) AS themes FROM t4),
t6 AS (SELECT *, CASE WHEN len(lead) = 0 AND len(themes) = 0 THEN {q(state.NO_OBJECTIVE)} ELSE
         array_to_string(list_concat(list_concat(lead[1:1], list_transform(lead[2:4], lambda x: '- ' || x)), list_transform(themes[1:3], lambda x: '- ' || x)), chr(10)) END AS objective_display,
       {without_stop('hint_next')} AS act1, {without_stop(first_of('f_steps', f"length(x) >= 10 AND NOT {_stale('x')} AND NOT {_superseded('x')} AND {apart}"))} AS act2,
       {without_stop(first_of(named('open_', ('continue', 'address', 'resolve', 'fix')), apart))} AS act3,
       {without_stop(first_of(f"[{next_from_text('l_continuation_context')}]", f"x <> '' AND NOT {_stale('x')} AND {apart}"))} AS act4,
       {derived('f_problems', 'f_goals')} AS act5 FROM t5),
st AS (SELECT *, coalesce(act1, act2, act3, act4, act5) AS next_action, coalesce(nullif(trim(label), ''), nullif(l_topic, ''), 'Assistant continuation') AS project_title,
       list_transform(list_filter(list_transform(string_split(objective_display, chr(10)), lambda s: trim(s)), lambda s: s <> ''), lambda s: CASE WHEN starts_with(s, '- ') THEN trim(substr(s, 3)) ELSE s END) AS objective,
       coalesce(nullif(place, ''), CASE WHEN len(completed_work) > 0 THEN 'Work in progress. Latest completed: ' || completed_work[-1] END, {q(state.NO_POSITION)}) AS current_state FROM t6)""", derived


_STATES, _derived = _states_sql()


def briefing_sql() -> str:
    nl = "chr(10)"
    body = f"'## PROJECT' || {nl} || {nl} || project_title || {nl} || {nl} || 'Objective:' || {nl} || objective_display || {nl} || {nl} || 'Current Position:' || {nl} || current_state || {nl} || {nl} || "
    body += " || ".join(f"'{title}:' || {nl} || {bullets(c)} || {nl} || {nl}" for title, c in (("Completed Work", "completed_work"), ("Active Problems", "active_problems"), ("Constraints", "constraints")))
    return f"{body} || 'Next Action:' || {nl} || next_action"


def _voiced(x: str) -> str:
    seen = " OR ".join(f"contains(lower({x}), {q(o)})" for o in state.OBSERVED)
    return f"CASE WHEN {seen} THEN {strip(f'array_to_string(list_transform(string_split({x}, chr(10)), lambda v: {voice('v')}), chr(10))')} ELSE {x} END"


STATES = f"{RECORDS},{SOURCES},{_STATES},\nbf0 AS (SELECT *, {strip(briefing_sql())} AS briefing0 FROM st),\nbf AS (SELECT *, {_voiced('briefing0')} AS briefing FROM bf0)"


def whole_sql() -> str:
    """CTE wh: the older form of the state, with the transcript unread."""
    return f"""{RECORDS},{SOURCES},{_STATES},
w0 AS (SELECT * EXCLUDE (place, completed_work, constraints, active_problems, next_action, objective, project_title, objective_display, current_state), {told('c', 'a_objective')} AS objective, {told('c', 'a_completed_work')} AS completed_work, {told('c', 'a_active_problems')} AS open_all,
       {told('c', 'a_resolved_problems')} AS resolved_all FROM st),
w1 AS (SELECT *, coalesce(nullif(own_place, ''), CASE WHEN len(completed_work) > 0 THEN 'Work in progress. Latest completed: ' || completed_work[-1] END, '') AS place FROM w0),
wh AS (SELECT conv, coalesce(nullif(trim(label), ''), nullif(l_topic, ''), 'Assistant continuation') AS project_title,
       CASE WHEN len(objective) = 1 THEN objective[1] WHEN len(objective) > 1 THEN {bullets('objective[1:12]')} WHEN l_topic <> '' THEN l_topic ELSE {q(state.NO_OBJECTIVE)} END AS objective_display,
       coalesce(nullif(place, ''), {q(state.NO_POSITION)}) AS current_state, {_derived('a_problems', 'a_goals')} AS next_action FROM w1)"""


def _joined(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


def handoff_sql() -> str:
    """CTE ho: conv, i, v1, v2, v3."""
    nl = "chr(10)"
    line = lambda title, n: f"CASE WHEN {n} <> '' THEN '**{title}:** ' || {n} || {nl} END"
    items = lambda title, n: f"CASE WHEN len({n}) > 0 THEN '**{title}:**' || {nl} || array_to_string(list_transform({n}, lambda b: '- ' || b), {nl}) || {nl} END"
    plain = strip(_joined(
        f"'# AI Handoff Context' || {nl}", line("Topic", "topic"), line("Summary", "summary"), items("Objectives", "objective"), line("Current state", "current_state"), items("Completed work", "completed_work"),
        items("Active problems", "active_problems"), items("Resolved problems", "resolved_problems"), items("Constraints", "constraints"), line("Continuation context", "continuation_context"), items("Important facts", "important_facts[1:12]"),
        items("Goals", "goals"), items("Open questions", "open_questions"), items("Decisions", "decisions"), items("Next steps", "next_steps"),
    ))
    section = lambda title, n, most: f"CASE WHEN len({n}) > 0 THEN {nl} || '## {title}' || {nl} || array_to_string(list_transform(({n})[1:{most}], lambda b: '- ' || b), {nl}) END"
    role2 = "CASE " + " ".join(f"WHEN regexp_matches(said, {java(p)}) THEN {q(r)}" for p, r in handoff.ROLE_HINTS) + " WHEN len(objective) > 0 THEN 'Assistant continuing an active task' ELSE 'Assistant continuing the prior conversation' END"
    both = "CASE WHEN lower(left(cur, 100)) = lower(left(ctx, 100)) THEN cur WHEN starts_with(ctx, left(cur, 120)) THEN ctx WHEN starts_with(cur, left(ctx, 120)) THEN cur WHEN NOT contains(ctx, cur) AND NOT contains(cur, ctx) THEN cur || ' ' || ctx ELSE cur END"
    named = f"CASE WHEN regexp_matches(lower(ctx), 'the next step would be to |the next actionable step is to |the next step is to |next: ') THEN {next_from_text('ctx')} END"
    step = f"CASE WHEN ctx <> '' AND cur <> '' AND ctx <> cur THEN coalesce(nullif({named}, ''), CASE WHEN length(ctx) > length(cur) + 20 THEN ctx END) END"
    v2 = _joined(
        q(f"{handoff.TITLE}\n\nContinue the conversation from where it stopped. Use only the context below.\n\n## Role"), role2, f"{nl} || '## Current position'",
        f"coalesce(nullif(CASE WHEN cur <> '' AND ctx <> '' THEN {both} WHEN cur <> '' THEN cur ELSE ctx END, ''), 'No explicit position captured.')", section("Completed work", "c_completed_work", 8), section("Open problems", "c_active_problems", 8),
        section("Recently resolved", "c_resolved_problems", 6), section("Constraints", "c_constraints", 6), f"{nl} || '## Next action'",
        f"coalesce({step}, objective[1], 'Address: ' || active_problems[1], 'Pick up from the current position and ask what to do next.')",
    )
    known2 = "(cur <> '' OR ctx <> '' OR len(objective) > 0 OR len(completed_work) > 0 OR len(active_problems) > 0)"
    by_kind = lambda table: "CASE archetype " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"
    starts = "regexp_matches(lower(x), '^(resolve|address|fix|answer)')"
    at = "position(left(mk, 40) IN lower(ctx))"
    rest = f"CASE WHEN contains(nk, mk) THEN regexp_replace(substr(ctx, {at} + length(mk)), '^[ ,.]+|[ ,.]+$', '', 'g') ELSE ctx END"
    chain = lambda parts: reduce(lambda a, b: f"list_concat({a}, {b})", parts)
    options = chain([
        f"[{next_from_text('ctx')}, {next_from_text('cur')}, {next_from_text('summ')}]", "c_objective", f"list_transform(c_active_problems, lambda x: CASE WHEN {starts} THEN x ELSE 'Address: ' || x END)", "c_next_steps",
        "list_transform(c_open_questions, lambda x: 'Answer: ' || x)", f"CASE WHEN ctx <> '' AND cur <> '' AND length(nk) > length(mk) + 25 AND NOT starts_with(nk, left(mk, 80)) AND length(rest) > 20 THEN [{capital('rest')}] ELSE [] END", "[dflt]",
    ])
    apart = f"NOT (place <> '' AND {told_alike('x', 'place')}) AND len(list_filter(spoken, lambda s: {told_alike('x', 's')})) = 0"
    wc = lambda x: f"len({words(x)})"
    lw = lambda x: wc(f"array_to_string({x}, ' ')")
    least = handoff.MIN_WORDS
    fill1 = f"list_reduce({distinct_sentences(sentences('summ'))}, lambda acc, x: CASE WHEN {wc('acc')} + base >= {least} OR {told_alike('x', 'acc')} THEN acc WHEN acc = '' THEN x ELSE acc || ' ' || x END, place)"
    fill2 = f"list_reduce(list_transform(list_concat(c_completed_work, c_important_facts), lambda x: [x]), lambda acc, x: CASE WHEN others + {lw('acc')} >= {least} OR len(list_filter(list_append(acc, pos), lambda k: {told_alike('x[1]', 'k')})) > 0 THEN acc ELSE list_concat(acc, x) END, done0)"
    fill3 = f"list_reduce(list_transform(c_constraints, lambda x: [x]), lambda acc, x: CASE WHEN {wc('pos')} + {wc('action')} + {lw('done')} + {lw('open_')} + {lw('solved')} + {lw('acc')} >= {least} OR list_contains(acc, x[1]) THEN acc ELSE list_concat(acc, x) END, held0)"
    fewer = lambda x, n: rf"CASE WHEN {wc(x)} <= {n} THEN {strip(x)} ELSE regexp_replace(array_to_string(({words(x)})[1:{n}], ' '), '[.,;]+$', '') || '…' END"
    short = lambda name, n: f"list_transform({name}, lambda y: {fewer('y', n)})"
    whole = lambda place: _joined(
        q(f"{handoff.TITLE}\n\nYou are picking up an in-progress conversation. Continue naturally — do not recap for a human audience.\n\n## Role"), "role3", f"{nl} || '## Current position'", place,
        section("Completed work", short("done", 35), 8), section("Open problems", short("open_", 35), 8), section("Recently resolved", short("solved", 30), 6), section("Constraints", short("held", 30), 6), f"{nl} || '## Next action'", "action",
    )
    trimmed = f"regexp_replace(array_to_string(({words('pos')})[1:greatest(30, {wc('pos')} - over)], ' '), '[.,;]+$', '') || '…'"
    known3 = "(cur <> '' OR ctx <> '' OR top <> '' OR summ <> '' OR " + " OR ".join(f"len({n}) > 0" for n in ("objective", "completed_work", "active_problems", "next_steps", "open_questions")) + ")"
    return f"""{RECORDS},
p0 AS (SELECT *, {_archetype_sql('conv')} AS archetype, {', '.join(f'{clean_items(n)} AS c_{n}' for n in handoff.LISTS)}, {voice('current_state')} AS cur, {voice('continuation_context')} AS ctx, {voice('topic')} AS top, {clean_summary('summary')} AS summ,
       concat_ws(' ', current_state, continuation_context, array_to_string(objective, ' ')) AS said, {plain} AS v1 FROM rec),
p1 AS (SELECT *, {v2} AS text2, {key('ctx')} AS nk, {key('cur')} AS mk, {by_kind(state.FALLBACKS)} AS dflt,
       {by_kind(state.ROLES)} || CASE WHEN trim(topic) <> '' AND length(trim(topic)) < 80 THEN ' — continue on: ' || trim(topic) ELSE ' — continue the prior conversation from the exact stopping point' END AS role3,
       {position('cur', 'ctx', 'summ', 'top')} AS place, {', '.join(f"({distinct_sentences(f'c_{n}')})[1:{m}] AS {a}" for n, m, a in (('completed_work', 8, 'done0'), ('active_problems', 8, 'open_'), ('resolved_problems', 6, 'solved'), ('constraints', 6, 'held0')))} FROM p0),
p2 AS (SELECT *, {sentences('place')} AS spoken, {rest} AS rest FROM p1),
p3 AS (SELECT *, {without_stop(f"coalesce({first_of(f'list_transform({options}, lambda o: {voice("o")})', f'length(x) >= 10 AND {apart}')}, dflt)")} AS action FROM p2),
p4 AS (SELECT *, {wc('action')} + {lw('done0')} + {lw('open_')} + {lw('held0')} + {lw('solved')} AS base FROM p3),
p5 AS (SELECT *, {fill1} AS pos FROM p4),
p6 AS (SELECT *, {wc('pos')} + {wc('action')} + {lw('open_')} + {lw('held0')} + {lw('solved')} AS others FROM p5),
p7 AS (SELECT *, {fill2} AS done FROM p6),
p8 AS (SELECT *, {fill3} AS held FROM p7),
p9 AS (SELECT *, {whole(f"coalesce(nullif({fewer('pos', 90)}, ''), 'Session stopped mid-thread; infer context from completed work and next action.')")} AS text3 FROM p8),
pa AS (SELECT *, {wc('text3')} - {handoff.MAX_WORDS} AS over FROM p9),
pb AS (SELECT *, CASE WHEN over > 0 AND {wc('pos')} > 40 AND {wc('pos')} <= 90 THEN {whole(trimmed)} ELSE text3 END AS text4 FROM pa),
ho AS (SELECT conv, i, v1, CASE WHEN {known2} THEN coalesce(nullif({_voiced('text2')}, ''), v1) ELSE v1 END AS v2, CASE WHEN {known3} THEN coalesce(nullif({_voiced('text4')}, ''), v1) ELSE v1 END AS v3 FROM pb)"""


def explain_sql() -> str:
    """CTE ex: conv and explanation."""
    nl = "chr(10)"
    observed = lambda x: f"({strip(x)} = '' OR regexp_matches({x}, {java(explain.OBSERVED)}))"
    plain = lambda items, n=1: f"list_filter({items}, lambda x: (NOT {observed('x')} AND length(x) >= {n}))"
    once = keep_first
    chain = lambda *parts: reduce(lambda a, b: f"list_concat({a}, {b})", parts)
    bare = f"regexp_replace({voice('x')}, {java(r'(?i)^(topic|objective|goal)\s*:\s*')}, '')"
    label = f"CASE WHEN length({bare}) > 90 THEN regexp_replace(left({bare}, 87), '[ ,;]+$', '') || '…' ELSE {bare} END"
    stop = lambda x: f"{without_stop(x)} || '.'"
    default = "CASE archetype " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in explain.OVERVIEWS.items()) + " END"
    covered = f"CASE WHEN len(topics) = 1 THEN 'This conversation focused on ' || {without_stop('topics[1]')} || '.' WHEN len(topics) > 1 THEN 'This conversation covered ' || {without_stop("array_to_string(topics[1:4], ', ')")} || '.' END"
    latest = lambda n, before: f"CASE WHEN len({n}) > 0 THEN {q(before)} || {stop(f'{n}[-1]')} END"
    problems = f"list_transform({plain('t_active_problems')}, lambda x: CASE WHEN ends_with(x, '?') THEN x ELSE 'Unresolved: ' || {without_stop('x')} END)"
    learned = f"list_transform({plain(chain('t_completed_work', 't_decisions', 't_resolved_problems', 't_goals'))}, lambda x: CASE WHEN starts_with(lower(x), 'learned ') THEN substr(x, 9) ELSE x END)"
    facts = plain(chain("t_important_facts", "t_completed_work", "t_constraints", "t_resolved_problems"), 12)
    threads = f"list_transform(topics[1:4], lambda t: 'Major thread: ' || {without_stop('t')})"
    body = f" || {nl} || {nl} || ".join(x for title, b in (("OVERVIEW", "overview"), ("MAIN TOPICS", bullets("topics")), ("LEARNINGS / DECISIONS", bullets("learnings")), ("CURRENT STATUS", "status"), ("OPEN QUESTIONS", bullets("questions")), ("KEY TAKEAWAYS", bullets("takeaways"))) for x in (q(title), b))
    return f"""{RECORDS},{SOURCES},
{CLEANED},
e0 AS (SELECT conv, {', '.join(f"{told('c', f'coalesce(flatten(list({c} ORDER BY i)), [])')} AS t_{c}" for c in state.LISTS)}, {', '.join(f'arg_max({c}, i) AS l_{c}' for c in state.TEXTS)},
       flatten(list(list_concat([topic], objective) ORDER BY i)) AS labels, list({clean_summary('summary')} ORDER BY i) AS sums FROM cr GROUP BY conv),
e1 AS (SELECT *, ({once(plain(f'list_transform(labels, lambda x: {label})'))})[1:14] AS topics, {once(plain('sums', 20))} AS summaries, ({once(learned)})[1:12] AS learnings,
       ({once(chain(plain('t_open_questions'), problems, plain('t_goals')))})[1:10] AS questions, {clean_summary('l_summary')} AS own, {position('l_current_state', 'l_continuation_context', 'l_summary', 'l_topic')} AS place FROM e0 JOIN src USING (conv)),
e2 AS (SELECT *, ({once(chain(facts, threads, 'learnings[1:3]'))})[1:8] AS takeaways, coalesce(CASE WHEN length(own) > 40 AND NOT {observed('own')} THEN own END, summaries[1], {covered}, {default}) AS lead FROM e1),
e3 AS (SELECT *, {stop("CASE WHEN label <> '' AND NOT contains(lower(lead), lower(label)) THEN " + without_stop('lead') + " || ' (' || label || ').' ELSE lead END")} AS overview,
       coalesce(CASE WHEN NOT {observed('place')} THEN {stop('place')} END, CASE WHEN length(l_continuation_context) > 30 AND NOT {observed('l_continuation_context')} THEN {stop('l_continuation_context')} END,
       {latest('t_active_problems', 'The conversation ended with open threads including ')}, {latest('t_completed_work', 'Progress was made on ')}, {latest('topics', 'The latest focus was ')}, {q(explain.PAUSE)}) AS status FROM e2),
ex AS (SELECT conv, {strip(body)} AS explanation FROM e3)"""


def merged_sql() -> str:
    """CTE mg: the merged record of every conversation, its recap as long as it fits uncut."""
    nl = "chr(10)"
    tok = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}'))"
    same_key = lambda a, b: f"{key(a)} = {key(b)}"
    by_key = lambda items, n: f"(list_transform({keep_first(f'list_filter({items}, lambda x: {strip("x")} <> {q("")})', same_key)}, lambda x: {strip('x')}))[1:{n}]"
    alike = lambda a, b: f"CASE WHEN len({tok(a)}) = 0 OR len({tok(b)}) = 0 THEN {key(a)} = {key(b)} ELSE len(list_intersect({tok(a)}, {tok(b)}))::DOUBLE / len(list_distinct(list_concat({tok(a)}, {tok(b)}))) >= 0.55 END"
    diverse = lambda items, n: f"({keep_first(f'list_filter(list_transform({items}, lambda x: {collapse("x")}), lambda x: x <> {q("")})', alike)})[1:{n}]"
    stops = r"regexp_replace({}, '[.,;:\- ]+$', '')"

    def cut(x: str, most: int) -> str:
        head = f"left({collapse(x)}, {most - 1})"
        shorter = stops.format(f"CASE WHEN contains({head}, ' ') THEN regexp_replace({head}, ' [^ ]*$', '') ELSE {head} END")
        return f"CASE WHEN length({collapse(x)}) <= {most} THEN {collapse(x)} ELSE {shorter} || '…' END"

    def soften(x: str) -> str:
        out = f"regexp_replace({collapse(x)}, '[.!?]+$', '')"
        for pattern in (r"(?i)^(the|a|an)\s+", r"(?i)^(segment|part|discussion|chunk)\s+\d+\s+(explored|focused on|addressed|covered)\s+", r"(?i)^the conversation (focused on|explored|addressed|centered on)\s+"):
            out = f"regexp_replace({out}, {java(pattern)}, '')"
        return f"list_transform([{out}], lambda o: CASE WHEN regexp_matches(o, '^\\p{{Lu}}') AND NOT regexp_matches(o, '^(\\p{{Lu}}\\p{{Lu}}|\\p{{Lu}}[^\\p{{L}}]|\\p{{Lu}}$)') THEN lower(left(o, 1)) || substr(o, 2) ELSE o END)[1]"

    def gist(x: str, most: int = 220) -> str:
        first = rf"regexp_extract({x}, '(?s)^(.*?[.!?](?:\s+|$))', 1)"
        sentence = f"CASE WHEN {first} <> '' AND length({first}) <= {most} THEN {strip(first)} ELSE {cut(x, most)} END"
        return f"coalesce(nullif({soften(sentence)}, ''), {soften(cut(x, most))})"

    parts = lambda x: collapse(f"regexp_replace({x}, {java(r'(?i)\[Part\s+\d+/\d+\]')}, '', 'g')")
    bridged = lambda items, bridges, form: f"list_transform(range(2, len({items}) + 1), lambda j: {form('[' + ', '.join(map(q, bridges)) + f'][least(j - 1, {len(bridges)})]', soften(f'{items}[j]'))})"
    nk = key
    both = f"CASE WHEN len(themes) > 1 THEN ' and ' || {soften('themes[2]')} ELSE '' END"
    about = f"""CASE WHEN topic <> '' THEN 'This discussion revisited ' || {collapse('topic')} || '. If you have not looked at this thread in months, the through-line was how the pieces fit together, not a loose collection of notes.'
      WHEN goal <> '' THEN 'This discussion centered on ' || goal || '.' WHEN opening <> '' THEN 'This discussion opened around ' || {gist('opening')} || '.' ELSE 'This discussion explored a technical problem from first principles.' END ||
      CASE WHEN opening <> '' AND topic <> '' AND {nk('opening')} <> {nk('topic')} THEN ' Early framing highlighted ' || {gist('opening')} || '.' ELSE '' END ||
      CASE WHEN len(themes) > 0 THEN ' The conversation kept returning to the idea that ' || {soften('themes[1]')} || {both} || ', which tied the later work together.'
      WHEN goal <> '' AND topic <> '' AND {nk('goal')} <> {nk('topic')} THEN ' The practical anchor throughout was ' || goal || '.' ELSE '' END"""
    evolution = f"""CASE WHEN n <= 1 THEN CASE WHEN opening <> '' THEN 'The exchange stayed focused on ' || {soften('opening')} WHEN goal <> '' THEN 'Work stayed oriented toward ' || goal || '.' ELSE 'The exchange moved in a single continuous arc without major topic shifts.' END ELSE
      CASE WHEN opening <> '' THEN 'The conversation began by examining ' || {soften('opening')} ELSE 'The conversation began with foundational definitions and constraints' END || ' and unfolded across ' || n || ' segments rather than one sitting' ||
      CASE WHEN tail <> '' AND {nk('tail')} <> {nk('opening')} THEN ', gradually tightening toward ' || {soften('tail')} WHEN goal <> '' THEN ', gradually tightening toward ' || goal WHEN topic <> '' THEN ', gradually tightening around ' || {soften('topic')} ELSE '' END ||
      '. Along the way, earlier exploratory ideas were tested against later constraints, so the thread reads as refinement rather than repetition.' END"""
    spoken = f"array_to_string({bridged('insights', recap.INSIGHT_BRIDGES, lambda b, x: f'{q(" ")} || {b} || {q(", ")} || {x} || {q(".")}')}, '')"
    insight = f"""CASE WHEN len(insights) = 0 THEN 'No single breakthrough dominated; understanding accumulated through linked observations.' ELSE 'Several insights emerged, including ' || {soften('insights[1]')} || '.' || {spoken} ||
      ' Taken together, these insights explain why later choices felt necessary rather than arbitrary.' END"""
    chosen = f"array_to_string(list_concat(['The group committed to ' || {soften('decided[1]')} || '.'], {bridged('decided', recap.DECISION_BRIDGES, lambda b, x: f'{b} || {q(" ")} || {x}')}), '. ')"
    decision = f"""CASE WHEN len(decided) = 0 THEN 'No firm decisions were recorded, though the direction of travel became clearer as constraints surfaced.'
      WHEN len(decided) = 1 THEN 'The group committed to ' || {soften('decided[1]')} || '.' ELSE {chosen} || '. These choices narrowed the design space for what followed.' END"""
    question = f"""CASE WHEN len(asked) = 0 THEN 'No major open questions were left on the table at the end of the thread.' WHEN len(asked) = 1 THEN 'One question still needs resolution: ' || {soften('asked[1]')} || '.' ELSE
      'Important questions remain, including ' || array_to_string(list_transform(asked[1:len(asked) - 1], lambda a: {soften('a')}), '; ') || '; and ' || {soften('asked[-1]')} || '. Answering these will determine how complete the eventual solution can be.' END"""
    focus = f"CASE WHEN goal <> '' THEN 'Current work is focused on ' || goal || '.' WHEN tail <> '' THEN 'Current work is focused on ' || {soften('tail')} || '.' END"
    move = f"""CASE WHEN len(steps) = 1 THEN 'The immediate next move is to ' || {soften('steps[1]')} || '.' WHEN len(steps) > 1 THEN 'The immediate next moves are to ' || {soften('steps[1]')} || ' and then ' || {soften('steps[2]')} || '.'
      WHEN tail <> '' AND goal = '' THEN 'The thread ended pointed toward ' || {soften('tail')} || '.' END"""
    direction = f"CASE WHEN {focus} IS NULL AND {move} IS NULL THEN 'The thread ended with exploratory momentum but no single named next action.' ELSE concat_ws(' ', {focus}, {move}) || ' That is the handoff point if you are picking this work back up.' END"
    whole = f" || {nl} || {nl} || ".join(f"{q(f'## {t}')} || {nl} || {nl} || {collapse(f'({b})')}" for t, b in zip(recap.TITLES, (about, evolution, insight, decision, question, direction), strict=True))
    one = "coalesce(nullif(closing, ''), opened)"
    every = lambda c: f"coalesce(flatten(list({c} ORDER BY i)), [])"
    lead = lambda c: f"list_concat(arg_max({c}, i), coalesce(flatten(list({c} ORDER BY i) FILTER (WHERE i < n - 1)), []))"
    return f"""{RECORDS},
m0 AS (SELECT conv, any_value(n) AS n, {', '.join(f'{by_key(every(c), recap.LIMITS[c])} AS {c}' for c in ('important_facts', 'decisions', 'open_questions'))}, {', '.join(f'{by_key(lead(c), recap.LIMITS[c])} AS {c}' for c in ('goals', 'next_steps'))},
       coalesce(arg_max(topic, i) FILTER (WHERE topic <> ''), '') AS topic, {parts('arg_min(summary, i)')} AS opened, {parts('arg_max(summary, i)')} AS closing, bool_and(form <> 4 AND (topic <> '' OR summary <> '')) AS parse_ok FROM rec GROUP BY conv),
m1 AS (SELECT *, {gist('opened')} AS opening, {gist('closing')} AS tail, coalesce({soften('goals[1]')}, '') AS goal, {diverse('important_facts', 2)} AS themes, {diverse('important_facts', 4)} AS insights, {diverse('decisions', 4)} AS decided,
       {diverse('open_questions[greatest(1, len(open_questions) - 7):]', 4)} AS asked, {diverse('next_steps', 2)} AS steps FROM m0),
mg AS (SELECT *, CASE WHEN n <= 1 AND {one} <> '' THEN {cut(one, recap.MAX_CHARS)} ELSE {whole} END AS recap FROM m1)"""


def analysis_sql() -> str:
    tok = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{4,}}'))"
    shared = lambda a, b: f"CASE WHEN len({tok(a)}) = 0 OR len({tok(b)}) = 0 THEN 0.0 ELSE len(list_intersect({tok(a)}, {tok(b)}))::DOUBLE / least(len({tok(a)}), len({tok(b)})) END"
    any_of = lambda x, needles: "(" + " OR ".join(f"contains({x}, {q(v)})" for v in needles) + ")"
    low, n = "lower(next_action)", f"len({words('next_action')})"
    point = lambda c, k=1: f"CASE WHEN {c} THEN {k} ELSE 0 END"
    action = f"greatest(0, least(5, CASE WHEN ends_with(next_action, '?') THEN 1 ELSE 2 END + {point(any_of(low, quality.VERBS), 2)} + {point(f'{n} BETWEEN 6 AND 30')} - {point(any_of(low, ('the slice', 'the session covers', 'the participant')))} - {point(f'{shared("next_action", "current_state")} > 0.7')}))"
    bad = f"coalesce(list_sum(list_transform(active_problems, lambda a: {point('regexp_matches(lower(a), ' + q('^the (learner|speaker) is') + ')')} + {point('contains(a, ' + q('?') + ')')})), 0)"
    problems = f"CASE WHEN len(active_problems) = 0 THEN 2 ELSE greatest(0, least(5, 2 - {bad} - {point('len(active_problems) > 5')})) END"
    pairs = f"list_sum(list_transform(completed_work, lambda c: len(list_filter(active_problems, lambda a: {shared('c', 'a')} >= 0.45))))"
    return f"""{STATES},
a0 AS (SELECT *, {action} AS na, {problems} AS ap, CASE WHEN len(completed_work) = 0 OR len(active_problems) = 0 THEN 0.0 ELSE {pairs}::DOUBLE / (len(completed_work) * len(active_problems)) END AS dup FROM bf),
a1 AS (SELECT *, {point('len(objective) > 0', 2)} + {point("trim(current_state) <> ''", 2)} + {point('len(completed_work) > 0')} + {point('len(constraints) > 0')} + least(2, na // 2) + least(1, ap // 3) - floor(dup * 3)::BIGINT AS pts FROM a0)
SELECT conv, greatest(0, pts)::BIGINT AS usefulness, CASE WHEN pts >= 7 THEN 'high' WHEN pts >= 4 THEN 'medium' ELSE 'low' END AS tier, na::BIGINT AS next_action_score, ap::BIGINT AS active_problems_score, round(dup, 3) AS duplication_rate FROM a1"""


def chunks_sql(name: str, source: str) -> str:
    """Recursive CTEs ending in ``name`` (conv, i, chunk): chunks with overlap of the texts of ``source`` (conv, t),
    whose paragraphs are no longer than a chunk."""
    n = name
    parts = rf"list_filter(list_transform(string_split(regexp_replace(t, '\n\s*\n+', chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"""
{n}_d AS (SELECT conv, {strip('t')} AS t FROM {source}),
{n}_l AS (SELECT conv, {parts} AS l FROM {n}_d WHERE length(t) > 4500),
{n}_p(conv, l, i, open_, done) AS (
  SELECT conv, l, 1, '', []::VARCHAR[] FROM {n}_l
  UNION ALL
  SELECT conv, l, i + 1, CASE WHEN open_ = '' THEN l[i] WHEN length(open_) + 2 + length(l[i]) <= 6000 THEN open_ || chr(10) || chr(10) || l[i] ELSE l[i] END,
    CASE WHEN open_ <> '' AND length(open_) + 2 + length(l[i]) > 6000 THEN list_append(done, open_) ELSE done END FROM {n}_p WHERE i <= len(l)
),
{n}_b AS (SELECT conv, CASE WHEN open_ = '' THEN done ELSE list_append(done, open_) END AS c FROM {n}_p WHERE i = len(l) + 1 UNION ALL SELECT conv, [t] FROM {n}_d WHERE length(t) BETWEEN 1 AND 4500),
{n}_o(conv, c, i, chunk) AS (
  SELECT conv, c, 1, c[1] FROM {n}_b
  UNION ALL
  SELECT conv, c, i + 1, CASE WHEN starts_with(c[i + 1], tail) THEN c[i + 1] ELSE tail || chr(10) || chr(10) || c[i + 1] END
  FROM (SELECT *, CASE WHEN length(chunk) <= 500 THEN chunk ELSE ltrim(right(chunk, 500), ' ' || chr(10)) END AS tail FROM {n}_o) WHERE i < len(c)
),
{n} AS (SELECT conv, (i - 1)::BIGINT AS i, chunk FROM {n}_o)"""


def sparse_sql() -> str:
    """CTE sp: conv, mode, n_chunks, rejected."""
    tok = lambda x: TOKENS.format(x)
    jac = lambda a, b: f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"
    clamp = lambda x: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"
    fixed = "0.16::DOUBLE * unresolved_pressure + 0.14::DOUBLE * reasoning_shift + 0.12::DOUBLE * architecture + 0.08::DOUBLE * failure + 0.08::DOUBLE * operational + 0.10::DOUBLE * conceptual_gravity + 0.10::DOUBLE * transition + 0.06::DOUBLE * constraint_binding"
    known = "array_to_string(acc.kept, chr(10))"
    most = f"greatest(x.near, {jac('x.tok', tok(known))})"
    score = f"round({clamp(f'0.18::DOUBLE * x.moved + 0.10::DOUBLE * round({clamp(f"1.0::DOUBLE - {most}")}, 4) - 0.08::DOUBLE * round({clamp(most)}, 4) + x.fixed')}, 4)"
    step = f"list_transform([{score}], lambda v: {{'kept': CASE WHEN v >= {S.RETAIN} THEN list_append(acc.kept, x.text)[greatest(1, len(acc.kept) - 2):greatest(1, len(acc.kept) - 2) + 3] ELSE acc.kept END, 'scores': list_append(acc.scores, v), 'text': '', 'tok': []::VARCHAR[], 'near': 0.0::DOUBLE, 'moved': 0.0::DOUBLE, 'fixed': 0.0::DOUBLE}})[1]"
    item = f"{{'kept': []::VARCHAR[], 'scores': []::DOUBLE[], 'text': text, 'tok': tok::VARCHAR[], 'near': o::DOUBLE, 'moved': trajectory_delta::DOUBLE, 'fixed': ({fixed})::DOUBLE}}"
    start = "{'kept': []::VARCHAR[], 'scores': []::DOUBLE[], 'text': '', 'tok': []::VARCHAR[], 'near': 0.0::DOUBLE, 'moved': 0.0::DOUBLE, 'fixed': 0.0::DOUBLE}"
    say = lambda when, what: f"CASE WHEN {when} THEN {q(what)} END"
    against = [
        say("n <= 1", "already_single_chunk"), say(f"chars > {sparse.MAX_CHARS}", f"total_chars_gt_{sparse.MAX_CHARS}"), say(f"n > {sparse.MAX_CHUNKS}", f"original_chunks_gt_{sparse.MAX_CHUNKS}"), say(f"spread > {sparse.MAX_SPREAD}", f"saliency_variance_gt_{sparse.MAX_SPREAD}"),
        say(f"evo >= {sparse.MAX_EVOLUTION}", f"evolution_likelihood_gte_{sparse.MAX_EVOLUTION}"), say("failing >= 3 AND n >= 4", "multi_chunk_failure_density"), say("evo >= 0.55 AND n >= 3 AND chars >= 2800", "high_operational_evolution_likelihood"),
    ]
    reasons = " + ".join(f"({c})::INT" for c in (f"chars <= {sparse.MAX_CHARS}", f"n <= {sparse.MAX_CHUNKS}", "thread", f"spread <= {sparse.MAX_SPREAD}", f"evo < {sparse.MAX_EVOLUTION}"))
    return f"""{_score_sql()},{SOURCES},
e AS (SELECT conv, failure, CASE WHEN transition > 0.35 AND failure < 0.12 THEN greatest(failure * 1.1::DOUBLE, operational * 0.5::DOUBLE, 0.22::DOUBLE)
      ELSE greatest(failure * 1.15::DOUBLE, reasoning_shift * 0.9::DOUBLE, operational * 0.85::DOUBLE, transition * 0.45::DOUBLE) END AS v FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY v DESC) AS r, count(*) OVER (PARTITION BY conv) AS n FROM e),
a AS (SELECT conv, avg(v) FILTER (WHERE r <= greatest(2, n // 2)) AS m, any_value(n) AS n, count(*) FILTER (WHERE failure >= 0.2) AS f FROM r GROUP BY conv),
ev AS (SELECT conv, round(least(1.0::DOUBLE, CASE WHEN n >= 2 AND f < 2 THEN least(m, 0.36::DOUBLE) ELSE m END), 4) AS evolution FROM a),
rs AS (SELECT conv, count(*) AS n, list_reduce(list({item} ORDER BY idx), lambda acc, x: {step}, {start}).scores AS scores, count(*) FILTER (WHERE failure >= 0.22) AS failing, count(*) FILTER (WHERE regexp_matches(text, {java(sparse.ISSUE)}))::DOUBLE / count(*) AS issue FROM scored GROUP BY conv),
rt AS (SELECT *, length({strip('conversation')}) AS chars, CASE WHEN n < 2 THEN 0.0 ELSE round(sqrt(list_sum(list_transform(scores, lambda s: (s - list_sum(scores) / n) * (s - list_sum(scores) / n))) / n), 4) END AS spread,
       issue >= 0.5 AND n <= {sparse.MAX_CHUNKS} AS thread FROM rs JOIN ev USING (conv) JOIN src USING (conv)),
ru AS (SELECT *, CASE WHEN thread THEN least(evolution, 0.34) ELSE evolution END AS evo FROM rt),
rv AS (SELECT *, concat_ws(',', {', '.join(against)}) AS rejected, {reasons} AS reasons FROM ru),
sp AS (SELECT conv, CASE WHEN rejected = '' AND reasons >= 3 THEN 'sparse_preserved' ELSE 'normal' END AS mode,
       CASE WHEN rejected = '' AND reasons >= 3 THEN least(n, CASE WHEN n > 4 OR chars > {sparse.TWO_CHARS} THEN 2 ELSE 1 END) ELSE n END AS n_chunks, rejected FROM rv)"""
