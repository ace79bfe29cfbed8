from pyspark.sql import functions as F

from threadloom.operators import extraction, recap

from test_state import SCHEMA, record


def merge(spark, rows):
    data = [(1, i, *[r[k] for k in extraction.LISTS], *[r[k] for k in extraction.SCALARS]) for i, r in enumerate(rows)]
    return recap.merge(spark.createDataFrame(data, SCHEMA).withColumn("parse_ok", F.lit(True))).first()


def value(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column).first()[0]


def test_pieces(spark):
    t = F.col("t")
    assert value(spark, recap.cut(t, 10), "alpha beta gamma") == "alpha…"
    assert value(spark, recap.cut(t, 30), " alpha  beta ") == "alpha beta"
    assert value(spark, recap.soften(t), "The Parser was written.") == "parser was written"
    assert value(spark, recap.soften(t), "API calls fail!") == "API calls fail"
    assert value(spark, recap.soften(t), "Segment 3 explored Deep things") == "deep things"
    assert value(spark, recap.first_sentence(t), "[Part 1/3] One here. Two.") == "One here."
    assert value(spark, recap.cut_words(t, F.lit(2)), "a b, c") == "a b…"


def test_lists_merge(spark):
    r = merge(spark, [
        record(topic="First", important_facts=["Fact one", "fact  ONE"], goals=["old goal", "shared"], next_steps=["a"], summary="S one."),
        record(topic="", important_facts=["Fact two"], goals=["Shared", "new goal"], next_steps=["b", "A"], summary="S two."),
    ])
    assert r.topic == "First" and r.important_facts == ["Fact one", "Fact two"]
    assert r.goals == ["Shared", "new goal", "old goal"] and r.next_steps == ["b", "A"]
    assert r.chunks == 2 and r.parse_ok


def test_recap_sections(spark):
    rows = [
        record(topic="Parsers", summary="The tokenizer was examined first. More.", important_facts=["Tokens carry positions", "Errors need recovery rules"], decisions=["Use recursive descent"], goals=["Finish the grammar"], open_questions=["Which encoding is used?"], next_steps=["Write tests"]),
        record(topic="Grammars", summary="Conflicts were resolved by priorities.", important_facts=["Precedence decides ties"], decisions=["Keep one pass only"], goals=["Finish the grammar"]),
    ]
    text = merge(spark, rows).summary
    assert [x[3:] for x in text.split("\n") if x.startswith("## ")] == list(recap.TITLES)
    assert "This discussion revisited Grammars." in text and "Early framing highlighted tokenizer was examined first." in text
    assert "The conversation began by examining tokenizer was examined first and unfolded across 2 segments rather than one sitting, gradually tightening toward conflicts were resolved by priorities." in text
    assert "Several insights emerged, including tokens carry positions. Building on that, errors need recovery rules. The thread also established, precedence decides ties." in text
    assert "The group committed to use recursive descent.. They also chose keep one pass only. These choices" in text
    assert "One question still needs resolution: which encoding is used." in text
    assert text.endswith("Current work is focused on finish the grammar. The immediate next move is to write tests. That is the handoff point if you are picking this work back up.")


def test_long_recaps_fit_and_single_chunks_keep_their_summary(spark):
    long = " ".join(f"word{i} is long" for i in range(400))
    rows = [record(topic=long, summary=long + ".", important_facts=[f"fact {i} " + " ".join(f"x{i}y{j}" for j in range(60)) for i in range(6)]) for _ in range(2)]
    text = merge(spark, rows).summary
    assert len(text) <= recap.MAX_CHARS
    assert merge(spark, [record(summary="[Part 1/1] Only this.")]).summary == "Only this."
