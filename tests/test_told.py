"""Whether the driver's conversations reach every branch of the state, hand-off and selection rules."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom import plans
from threadloom.operators import embedding, extraction, quality, selection, state
from threadloom.plans import told

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    return made


def counts(con, ctes, source, **conditions):
    sql = plans.materialised(f"WITH {ctes} SELECT {', '.join(f'count(*) FILTER (WHERE {c}) AS {n}' for n, c in conditions.items())} FROM {source}")
    return con.sql(sql).df().iloc[0].to_dict()


def test_every_state_rule_is_reached(con):
    got = counts(
        con, told.STATES, "bf", thanks="thanked", course="has_course", fetch_="hint_next LIKE '%Fetch API%'", offer_="hint_next LIKE 'Pick up%'", closed_="closed", moved_="moved", turned_="turned", quiz="len(quiz_words) > 0",
        phrase="starts_with(lower(late[asked + 1:]), 'what do you think')", dropped=f"len(open_) < len({told.told('c', 'f_active_problems')})", solved="len(active_problems) < len(open_)", history="len(themes) > 0",
        by_hint="act1 IS NOT NULL", by_step="act1 IS NULL AND act2 IS NOT NULL", by_problem="coalesce(act1, act2) IS NULL AND act3 IS NOT NULL", by_context="coalesce(act1, act2, act3) IS NULL AND act4 IS NOT NULL", derived="coalesce(act1, act2, act3, act4) IS NULL",
        default_action="next_action LIKE 'Continue the community thread%'", no_place="place = ''", no_goal="len(lead) = 0 AND len(themes) = 0", unnamed="label = ''",
    )
    assert all(got.values()), got


def test_every_hand_off_rule_is_reached(con):
    got = counts(con, told.handoff_sql(), "pb", long="over > 0", trimmed=r"over > 0 AND len(regexp_extract_all(pos, '\S+')) BETWEEN 41 AND 90", padded="pos <> place", more_work="len(done) > len(done0)", plain="v1 <> ''")
    assert all(got.values()), got


def test_the_later_of_two_anchors_parts_quiz_and_pivot(spark):
    """A question mark before, the phrase after: words of the quiz are those after the phrase."""
    schema = "conv long, conversation string, current_state string"
    rows = spark.createDataFrame([(1, "Is the banana ripe? Or. What do you think about folders now. Different topic", "")], schema)
    record = F.struct(*[F.lit("").alias(n) for n in state.TEXTS])
    got = state.signals(rows.withColumn("terminal", record)).first()
    assert "folders" in got._quiz_words and "banana" not in got._quiz_words


def test_clusters_follow_the_budget(spark):
    rows = spark.createDataFrame([(1, i, [float(i % 7 == j) for j in range(7)]) for i in range(21)], "conv long, idx int, embedding array<double>")
    kinds = lambda budget: embedding.clustered(rows, budget).select("cluster").distinct().count()
    assert kinds(7) == 7 and kinds(2) == 2 and kinds(None) == 5


def test_strategies_and_few_chunks(spark):
    rows = spark.createDataFrame([(c, i, f"text {i}" if i != 1 else " ") for c, n in ((1, 10), (2, 4)) for i in range(n)], "conv long, idx int, text string")
    got = {s: {r.conv: (r.strategy, r.selected) for r in selection.choose(rows, 5, s).collect()} for s in ("adaptive", "head_tail", "head")}
    assert got["head"][1] == ("head", [0, 1, 2, 3, 4]) and got["head_tail"][1] == ("head_tail", [0, 1, 2, 7, 8])
    assert len(got["adaptive"][1][1]) == 5 and all(g[2] == ("full", [0, 1, 2]) for g in got.values())
    with pytest.raises(ValueError):
        selection.choose(rows, 5, "other")


def test_a_stream_of_tokens_ends_at_a_repeated_fact():
    facts = [f'"fact {i}"' for i in range(8)]
    tokens = ['{"important_facts": [', *[t for f in [*facts, '"Fact  3"', '"fact 99"'] for t in (f, ", ")], "]}"]
    text = extraction.until_repeat(iter(tokens), least_facts=8, least_tokens=4)
    assert text.endswith('"Fact  3"') and "fact 99" not in text
    assert extraction.until_repeat(iter(tokens), least_facts=20, least_tokens=4) == "".join(tokens)
    assert extraction.until_repeat(iter(tokens)) == "".join(tokens)


def ended_plainly(stream, least_facts, least_tokens):
    """The whole text read again at each quote."""
    text = ""
    for n, token in enumerate(stream, 1):
        text += token
        if n >= least_tokens and '"' in token:
            inside = re.search(r'"important_facts"\s*:\s*\[((?:\s*,?\s*"(?:[^"\\]|\\.)*")*)', text, re.S)
            facts = [" ".join(f.lower().split()) for f in re.findall(r'"((?:[^"\\]|\\.)*)"', inside[1] if inside else "", re.S)]
            if len(facts) >= least_facts and len(set(facts)) < len(facts):
                break
    return text


def test_streams_end_where_the_whole_text_says_so():
    rng, ended = random.Random(4), 0
    parts = ['"important_facts"', " ", ":", "[", "]", ",", '"', "a", "B", "\\", '\\"', '"a"', '"b"', '", "', "\n", '"important', '_facts": [', *['"a", ', '"b", ', '"A", '] * 6]
    for _ in range(3000):
        start = rng.choice((['{"important_facts": ['], ['{"important_facts"', " ", ":", " ["], [], ['"important_facts" x ', '"important_facts":[']))
        tokens = [*start, *(rng.choice(parts) for _ in range(rng.randint(0, 25)))]
        least = rng.randint(1, 4), rng.randint(1, 8)
        want = ended_plainly(tokens, *least)
        assert extraction.until_repeat(iter(tokens), *least) == want, tokens
        ended += want != "".join(tokens)
    assert ended > 200


def test_a_long_stream_is_read_once():
    tokens = ['{"important_facts": [', *(t for i in range(100_000) for t in (f'"fact {i}"', ", ")), '"fact 7"', ', "more"']
    begun = time.monotonic()
    assert extraction.until_repeat(iter(tokens)) == "".join(tokens[:-1])
    assert time.monotonic() - begun < 20


def test_proxies(spark):
    rows = spark.createDataFrame([("/x/tutorial/a.txt", "todo " + "w" * 600), ("/x/reddit/a.txt", "why?\n" * 10), ("/x/y", "fine")], "path string, text string")
    got = {r.path[3:6]: (r.archetype, r.usefulness, r.tier, r.next_action_score, r.duplication_rate) for r in quality.proxy_analysed(rows).collect()}
    assert got["tut"] == ("tutorial", 7, "high", 2, 0.1)
    assert got["red"] == ("casual_chat", 0, "low", 1, 0.35) and got["y"] == ("other", 3, "low", 2, 0.1)
