"""That work is spread over tasks, files and calls as tables grow, with the same results."""

import json
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions import voice as V
from threadloom.operators import embedding, ranking
from threadloom.sources import checkpoints, transcripts
from threadloom.sources.store import Store
from threadloom.streaming import updates


def test_clusters_in_more_tasks_than_their_bytes_would_give(spark):
    draw = np.random.default_rng(1)
    points = {c: draw.normal(size=(3 + c % 12, 4)) for c in range(40)}
    rows = spark.createDataFrame([(c, i, [float(x) for x in v]) for c, p in points.items() for i, v in enumerate(p)], "conv long, idx int, embedding array<double>")
    out = embedding.clustered(rows)
    assert out.schema.simpleString() == "struct<conv:bigint,idx:int,embedding:array<double>,cluster:int>"
    assert out.rdd.getNumPartitions() >= 4
    got = {(r.conv, r.idx): r.cluster for r in out.collect()}
    for c, p in points.items():
        k = min(len(p), max(3, -(-len(p) // 5)))
        labels = np.arange(len(p)) if len(p) <= k else embedding.k_means(p, k)
        assert [got[c, i] for i in range(len(p))] == list(labels)
    assert embedding.clustered(rows, 1 << 30).where("cluster <> idx").count() == 0


def test_ranking_clusters_once(spark):
    rows = spark.createDataFrame([(c, i, [float(i % 3), 1.0 + c]) for c in range(4) for i in range(12)], "conv long, idx int, embedding array<double>")
    ranked = ranking.rank(embedding.clustered(rows))
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repart") == 1 and "Join" not in plan
    assert [(r.n, r.k, len(r.selected)) for r in ranked.collect()] == [(12, 3, 3)] * 4


def test_many_transcripts_in_few_files(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("x/"), "id", F.when(F.col("id") % 2 == 0, ".txt").otherwise(".json")).alias("path"), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" t "), "id")).otherwise(F.to_json(F.struct(F.col("id").cast("string").alias("body")))).alias("value"))
    transcripts.write_packed(rows, str(tmp_path / "packed"), buckets=4)
    assert len(list((tmp_path / "packed").glob("*.parquet"))) == 4
    got = {r.label: r.text for r in transcripts.read_packed_transcripts(spark, str(tmp_path / "packed")).collect()}
    assert got == {str(i): f"t {i}" if i % 2 == 0 else str(i) for i in range(200)}
    assert [r.label for r in transcripts.read_packed_transcripts(spark, str(tmp_path / "packed"), limit=3).collect()] == ["0", "10", "100"]


def test_many_sessions_in_few_files_and_a_session_replaces_its_own(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), checkpoints.ARTIFACTS, key="session", buckets=4)
    files = spark.range(100).select(F.concat(F.lit("s"), "id").alias("session"), F.explode(F.array(F.lit("a.txt"), F.lit("b.txt"))).alias("name"), F.lit("old").alias("text"))
    checkpoints.store_artifacts(files, store, 1)
    assert len(list((tmp_path / "store").rglob("*.parquet"))) == 4
    checkpoints.store_artifacts(spark.createDataFrame([("s7", "a.txt", "new")], "session string, name string, text string"), store, 2)
    got = {(r.session, r.name): r.text for r in checkpoints.stored_artifacts(store).collect()}
    assert len(got) == 199 and got["s7", "a.txt"] == "new" and ("s7", "b.txt") not in got and got["s8", "b.txt"] == "old"


def test_json_records_do_not_pass_through_yaml(spark):
    record = {"checkpoint": {"format_version": 2, "project": "p", "filler": [f"word {i}: {{x}}" for i in range(4000)], "state": {"objective": ["o"], "current_state": "c", "next_action": "n"}}}
    rows = spark.range(0, 120, 1, 4).select(F.concat(F.lit("r"), "id", F.lit(".json")).alias("file"), F.current_timestamp().alias("modified"), F.lit(json.dumps(record)).alias("value"))
    began = time.monotonic()
    found = checkpoints.read_rows(rows).where("record.project = 'p' AND size(issues) = 0").collect()
    assert len(found) == 120 and time.monotonic() - began < 12


def _plain(text):
    out = T.strip(F.coalesce(text, F.lit("")))
    for pattern, said in V.OBSERVER:
        out = F.regexp_replace(out, pattern, said)
    return T.strip(F.regexp_replace(out, rf"{T.SPACES}+", " "))


def test_voice_and_spaces_as_with_every_pattern(spark):
    said = [None, "", "   ", "a  b", "a \tb", "a b", " a   b ", "a b c", "  People reading  on", "People are", "the people reading", "No one has yet come", "no one has yet"]
    for who in ("participant", "participants", "slice", "discussion", "conversation", "tutor", "learner", "cluster"):
        said += [f"{a}{who} {b}  x" for a in ("The ", "the ", "this ", "This ", "") for b in ("is being asked", "is", "was explaining", "covers", "are debating", "has", "explores", "was at")]
    rows = spark.createDataFrame([(s,) for s in said], "s string")
    spaces = T.strip(F.regexp_replace(F.lower(F.coalesce("s", F.lit(""))), rf"{T.SPACES}+", " "))
    got = rows.select("s", V.clean_voice(F.col("s")).alias("a"), _plain(F.col("s")).alias("b"), T.norm_key(F.col("s")).alias("c"), spaces.alias("d")).collect()
    assert len(got) == len(said) and all(r.a == r.b and r.c == r.d for r in got)


def test_patterns_are_left_out_where_none_can_match(spark):
    rows = spark.range(0, 60_000, 1, 4).select(F.array(F.concat(F.lit("Some words about table "), F.col("id"), F.lit(" and what follows from it"))).alias("plain"), F.array(F.concat(F.lit("A slice of words about "), F.col("id"), F.lit(" and what follows it"))).alias("marked"))

    def seconds(name):
        began = time.monotonic()
        rows.select(F.sum(F.length(F.get(V.clean_items(F.col(name)), F.lit(0))))).collect()
        return time.monotonic() - began

    seconds("plain"), seconds("marked")
    assert min(seconds("plain") for _ in range(3)) < 0.7 * min(seconds("marked") for _ in range(3))


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _Map:
    """Counts the calls that would go to the state's process."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattribute__(self, name):
        if name not in ("held", "calls"):
            self.calls += 1
        return object.__getattribute__(self, name)

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held.get(key)

    def keys(self):
        return iter(list(self.held))

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        self.held.pop(key, None)


def test_state_is_read_and_written_once_a_trigger():
    own = updates.Updates(lambda chunk, place, total: f"r {chunk}")
    own.extent, own.places = _Value(), _Map()
    asked = []
    own.extract = lambda chunk, place, total: asked.append(chunk) or f"r {chunk}"
    make = lambda version, n: {"conv": 1, "version": version, "text": "x" * n, "pieces": [{"place": i, "hash": f"h{i}", "chunk": f"c{i}"} for i in range(n)]}
    first = pd.concat(own.handleInputRows((1,), iter([pd.DataFrame([make(v, 50 + v) for v in range(1, 6)])]), None))
    assert own.places.calls <= 60 and len(own.places.held) == 55 and len(asked) == 55
    assert (first["kind"] == "extracted").sum() == 55 and len(first) == sum(50 + v for v in range(1, 6))
    before = own.places.calls
    again = pd.concat(own.handleInputRows((1,), iter([pd.DataFrame([make(6, 56), make(6, 10), make(7, 3)])]), None))
    assert own.places.calls - before <= 4 and list(again["kind"]).count("reused") == 55 and list(again["kind"]).count("rejected") == 1
