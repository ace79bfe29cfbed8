import math
import random

import pytest

from threadloom.llm import html, language


def corpus(seed, n=400):
    rng = random.Random(seed)
    parts = {"aa": ["the", "ing", "tion", "er", "and", "th"], "bb": ["öß", "sch", "ung", "en", "der", "ü"], "cc": ["ño", "que", "ción", "el", "los", "as"]}
    rows = []
    for _ in range(n):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        rows.append((lang, " ".join(words)))
    return rows


def naive(samples, text, order=language.ORDER):
    """Code length by dictionaries, byte by byte, as the definition says."""
    known = {b for texts in samples.values() for t in texts for b in t}
    out = {}
    for name, texts in samples.items():
        tree = {}
        for t in texts:
            s = [b if b in known else None for b in t]
            for i, b in enumerate(s):
                for k in range(order + 1):
                    if i >= k:
                        tree.setdefault(tuple(s[i - k : i]), {}).setdefault(b, 0)
                        tree[tuple(s[i - k : i])][b] += 1
        s, bits = [None] * order + [b if b in known else None for b in text], 0.0
        for i in range(order, len(s)):
            for k in range(order, -1, -1):
                seen = tree.get(tuple(s[i - k : i]))
                if not seen:
                    continue
                total = sum(seen.values()) + len(seen)
                if s[i] in seen:
                    bits += math.log2(total / seen[s[i]])
                    break
                bits += math.log2(total / len(seen))
            else:
                bits += 8
        out[name] = bits
    return out


def test_code_lengths_are_exact():
    samples = {}
    for lang, text in corpus(1, 12):
        samples.setdefault(lang, []).append(text.encode())
    model = language.fit(samples)
    for text in ("the tion", "öß und ñ", "", "xyz \U0001f600 ing", corpus(2, 1)[0][1]):
        got = language.code_lengths(model, [text.encode()], block=5)[0]
        want = naive(samples, text.encode())
        assert got == pytest.approx([want[x] for x in model.languages], rel=1e-5, abs=1e-6)


def test_held_out_accuracy(docs, spark):
    rows = corpus(3, 800)
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    held = language.held_out()
    model = language.fit(language.sample(df, ~held))
    out = language.identify(df, model).withColumn("held", held).where("held").collect()
    assert len(out) > 100
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_edge_rows(docs, spark):
    df = docs([(1, None), (2, ""), (3, "12 !?"), (4, "a"), (4, "a"), (None, "word")])
    model = language.fit({"aa": [b"a word and a word"], "bb": [b"zzz"]})
    out = sorted(((r.doc_id, r.lang_pred, r.score) for r in language.identify(df, model).collect()), key=repr)
    assert [x for x in out if x[0] in (1, 2, 3)] == [(k, "und", 0.0) for k in (1, 2, 3)]
    assert all(r[1] == "aa" and 0 < r[2] <= 1 for r in out if r[0] in (4, None)) and len(out) == 6
    empty = language.identify(docs([]), language.fit({}))
    assert empty.count() == 0
    assert language.identify(df, language.fit({})).where("lang_pred <> 'und'").count() == 0
    clash = language.identify(df.withColumnRenamed("lang", "score"), model)
    assert sorted(clash.columns) == sorted(set(clash.columns)) and clash.where("score BETWEEN 0 AND 1").count() == 6


def test_size_follows_the_languages_own_contexts(spark, monkeypatch):
    import random

    rng = random.Random(2)
    samples = {}
    for k in range(16):  # alphabets that hardly overlap
        letters = [chr(0x400 + 6 * k + j) for j in range(9)]
        samples[f"l{k}"] = ["".join(rng.choice([*letters, " "]) for _ in range(20_000)).encode()]
    model = language.fit(samples)
    own = sum(len(b) for b in model.bits)
    dense = len(model.rows[0]) * len(samples)
    assert own < dense / 4
    assert language.code_lengths(model, samples["l3"]).argmin() == model.languages.index("l3")
    monkeypatch.setattr(language, "MOST_MODEL_BYTES", 1000)
    with pytest.raises(ValueError):
        language.fit(samples)
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    df = spark.createDataFrame([(i, "word", lang) for i, lang in enumerate("aaabbc")], "doc_id long, text string, lang string")
    assert sorted(language.sample(df, language.F.lit(True))) == ["a", "b"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body><nav><ul><li><a href="/">home</a></li></ul></nav><header><h1>Site name</h1></header><!-- <p>hidden</p> -->
<div class="ad">Buy, now. Cheap.</div><div id="cookie-notice"><p>We use cookies, fine?</p></div>
%s
<aside><p>Also read this, please.</p></aside><section class="comments"><p>I like it, much.</p></section>
<form><label>Mail</label></form><footer>&copy; all, of it.</footer></body></html>"""
STORY = "<h2>A  story</h2><p>First &amp; <b>bold</b> line,\n of text.<p>Second&nbsp;one &lt;here&gt;.</p><ul><li>item<li>next</ul>"
WANT = "A story\nFirst & bold line, of text.\nSecond one <here>.\nitem\nnext"


def test_marked_article():
    assert html.main_text(PAGE % f"<article>{STORY}</article>") == WANT
    assert html.main_text(PAGE % f"<main><div>{STORY}</div></main>") == WANT
    assert html.main_text(PAGE % f"<article>{STORY}") == WANT


def test_unmarked_page_by_ratios():
    body = "".join(f"<p>Sentence {i}, with some length, and a full stop. And one more, too.</p>" for i in range(6))
    links = "".join(f"<div><a href=x>link {i}</a></div>" for i in range(9))
    got = html.main_text(f"<body><div><span>Top</span></div>{links}<div id=c>{body}</div><div>x</div></body>")
    assert got == "\n".join(f"Sentence {i}, with some length, and a full stop. And one more, too." for i in range(6))


def test_a_mark_elsewhere_does_not_shut_out_the_body_text():
    lines = [f"Sentence {i}, with some length, and a full stop. And one more, too." for i in range(6)]
    body = "".join(f"<div>{x}</div>" for x in lines)
    for card in ("<article><p>Card.</p></article>", "<div role=main>Card.</div>"):
        assert html.main_text(f"<body><div id=c>{body}</div>{card}</body>").split("\n") == [*lines, "Card."]
    # short text outside the marked part has no mark to lift it
    assert html.main_text(f"<body><div>Top</div><main>{body}</main><section>x</section></body>").split("\n") == lines


def test_short_text_among_content_of_an_unmarked_page():
    assert html.main_text(PAGE % STORY) == WANT
    assert html.main_text(PAGE % f"<div><div>{STORY}</div></div>") == WANT
    long = "Some words of a sentence, and more of them. " * 7
    links = "".join(f"<li><a href=x>link {i}</a></li>" for i in range(9))
    for n, m in ((5, 5), (20, 1)):
        text, items = [f"{i} {long}".strip() for i in range(n)], [f"Item {i} of a list in the article." for i in range(m)]
        ps, lis = "".join(f"<p>{x}</p>" for x in text), "".join(f"<li>{x}</li>" for x in items)
        more = "<table><tr><td>cell<td>7</table><blockquote>Short.</blockquote><figure><figcaption>Caption</figcaption></figure>"
        got = html.main_text(f"<body><div>Top</div><ul>{links}</ul><div><div>{ps}</div><ul>{lis}</ul><ul>{links}</ul>{more}<p>{long}</p></div><div>x</div></body>")
        assert got.split("\n") == [*text, *items, "cell", "7", "Short.", "Caption", long.strip()]


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain &am text", "plain &am text"), ("<p", "<p"), ("<!-- open <p>a</p>", ""), ("<script>if (a<b) x", ""),
    ("<p>a<br>b</p>", "a b"), ('<article><p title="a>b">x</p></article>', "x"), ("<article>a < b & c</article>", "a < b & c"), ("<nav>only menu</nav>", ""),
])
def test_edges(page, want):
    assert html.main_text(page) == want


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE % f"<article>{STORY}</article>", "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    out = sorted(map(tuple, html.extract(df).collect()), key=repr)
    assert out == [(1, "u", WANT, len(WANT)), (2, None, "", 0), (2, None, "", 0)]
    assert html.extract(df.limit(0)).count() == 0


ICONS = [
    '<svg class="i"/>', "<svg class='i'><path d='M0'/><title>x</title></svg>", "<svg><svg><text>in</text></svg><text>out</text></svg>", "<!-->", "<!--->", "<!-- a --!>",
    "<template><p>no, not this, at all.</p></template>", "<noscript>", "<noscript><p>Turn it on, please.</p></noscript>", "<template>", "<svg>", "<math/>", "<div><svg><g></div>",
]


@pytest.mark.parametrize("icon", ICONS)
def test_markup_that_holds_no_text_of_the_page(icon):
    for page in (PAGE % f"{icon}<article>{STORY}</article>", PAGE % f"<article>{icon}{STORY}</article>", (PAGE % f"<article>{STORY}</article>").replace("<body>", f"<body>{icon}"), PAGE % f"<article><div>{icon}</div>{STORY}</article>"):
        assert html.main_text(page) == WANT, page


def test_formulas_are_text():
    formula = "<math><mrow><mi>x</mi><mo>=</mo><mn>2</mn><mspace/></mrow><annotation>x=2</annotation></math>"
    assert html.main_text(f"<article><p>where {formula} holds</p></article>") == "where x=2 holds"
    for icon in ("<svg><g><path/></g></svg>", "<noscript><div>a</div></noscript>", "<template><li>a</template>", "<svg/>"):
        assert html.main_text(f"<article><p>a {icon} b</p><p>c</p></article>") == "a b\nc"


def test_readers_comments_by_structure():
    said = "".join(f'<div class=item><span class="author">Ann {i}</span> <time>May</time><p>I think, and so on, that it is so, as I said. {i}</p></div>' for i in range(3))
    body = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    for section in (f"<section id=responses><h3>Said</h3>{said}</section>", f"<section id=r7><h3>Said</h3>{said}</section>", f"<ol>{said.replace('div', 'li')}</ol>"):
        assert html.main_text(f"<body><article>{body}{section}</article></body>").split("\n") == PARAGRAPHS
    # sections of an article that name no writer stay, as does the one writer of the article
    plain = "".join(f"<section class=s><h2>Part {i}</h2><p>{x}</p></section>" for i, x in enumerate(PARAGRAPHS))
    assert len(html.main_text(f"<article><p class=author>By Ann, <time>May</time>.</p>{plain}</article>").split("\n")) == 2 * len(PARAGRAPHS) + 1


def plain_holders(found, keep):
    """Which elements hold the content, by the definition: every pair of element and block is looked at."""
    def line(node):
        return [] if node is None else [*line(node.up), node]

    lines = {id(b): line(b.node) for b in found}
    order = []
    for b in found:
        order += [n for n in lines[id(b)] if not any(n is m for m in order)]
    kept = [b for b in found if b.node.path in keep]
    mass = {id(n): sum(len(b.text) for b in kept if any(n is m for m in line(b.node.up or b.node))) for n in order}
    total = sum(len(b.text) for b in kept)
    content = {id(b.node.up or b.node) for b in kept if b.node.name == "p"}
    if total:
        content.add(id([n for n in order if mass[id(n)] >= 0.9 * total][-1]))
    for n in order:
        up = n.up
        if up is not None and id(up) in content and n.hinted == up.hinted and (up.marked or up.name not in ("", "html", "body") or n.name in html.TEXT_ELEMENTS or mass[id(n)] > 0):
            content.add(id(n))
    return content


def test_holders_of_the_content_against_a_plain_reading():
    import random

    rng = random.Random(7)

    def grow(depth):
        tag = rng.choice(["div", "section", "ul", "table", "p", "h2", "article"]) if depth else "body"
        name = rng.choice(["", "", "", " class=ad", " id=x"])
        if tag in ("p", "h2") or depth > 3:
            return f"<{rng.choice(['p', 'li', 'div'])}{name}>{' '.join(rng.choice(['word', 'a', 'longer,', 'end.']) for _ in range(rng.randint(1, 40)))}"
        return f"<{tag}{name}>{''.join(grow(depth + 1) for _ in range(rng.randint(1, 5)))}</{tag}>"

    for _ in range(150):
        found = html.blocks(grow(0))
        if found:
            keep = html.content_paths(found)
            want = plain_holders(found, keep)
            html._hold_content(found, keep)
            assert {id(n) for n in html.around(found) if n.content} == want


PARAGRAPHS = [f"Sentence {i}, with some length, and a full stop. And one more, too." for i in range(8)]


@pytest.mark.parametrize("wrapped", [
    '<div class="site has-sidebar"><div class="entry">%s</div></div>', '<div class="no-sidebar"><article>%s</article></div>',
    '<article><div class="social-studies">%s</div></article>', '<div class="widget"><div class=nav>%s</div></div>', "<div>%s</div>", "<section><div><div>%s</div></div></section>",
])
def test_a_wrapper_with_the_name_of_a_part_keeps_its_article(wrapped):
    body = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    for beside in ("", '<div class="ad">Buy, now, and cheap. At the shop, today.</div>', "<nav><a href=x>menu</a></nav>"):
        if "ad" in beside and "widget" in wrapped:
            continue  # both bear names of parts, and nothing on the page else
        assert html.main_text(f"<body>{beside}{wrapped % body}{beside}</body>").split("\n") == PARAGRAPHS


def test_short_items_stay_and_hinted_parts_go():
    body = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    more = "<ul><li>one</li><li>two</li></ul><pre>x = 1</pre><blockquote>Said.</blockquote><table><tr><td>1<td>2</table>"
    advert = '<div class="ad-slot">Buy this, now. Really, buy this thing, today or tomorrow, at the shop.</div>'
    said = "<div class=comment><p>I like it, much, and more than so, really so, and a lot, you know, as ever.</p></div>" * 30
    for around in ("<div class=c>%s</div>", "<article>%s</article>"):
        page = f"<body>{around % (body + more + advert + body)}<div class='comments'>{said}</div></body>"
        assert html.main_text(page).split("\n") == [*PARAGRAPHS, "one", "two", "x = 1", "Said.", "1", "2", *PARAGRAPHS]
    few = '<body><div class="ad">Other, words, here. Yes, they are.</div><article><h1>Title.</h1></article></body>'
    assert html.main_text(few) == "Title."


def test_broken_and_deep_pages_take_time_in_proportion():
    import time

    for page in ("<div>" * 200_000 + "text", '<a href="' * 120_000, "<p>" * 100_000 + "x", "<b>x</b><i>" * 50_000, "<ul><li>" * 50_000 + "y", "<a b='\"'\">z" * 50_000, "</div>" * 100_000, "<p 'x>y" * 100_000):
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 10


def test_paths_against_a_plain_reading():
    """Random trees of plain elements: the kept paths by sums over a parsed tree, in quadratic time."""
    import random
    from xml.etree import ElementTree

    rng = random.Random(6)

    def grow(depth):
        tag = rng.choice(["div", "section", "ul", "p", "h2"]) if depth else "body"
        if tag in ("p", "h2") or depth > 3:
            text = " ".join(rng.choice(["word", "a", "longer,", "end."]) for _ in range(rng.randint(1, 40)))
            return f"<p>{f'<a>{text}</a>' if rng.random() < 0.2 else text}</p>"
        return f"<{tag}>{''.join(grow(depth + 1) for _ in range(rng.randint(1, 5)))}</{tag}>"

    for _ in range(60):
        page = grow(0)
        leaves = []

        def walk(node, path, leaves=leaves):
            path = (*path, node.tag)
            if node.tag == "p":
                text = "".join(node.itertext())
                leaves.append((path, text, len(text) if len(node) else 0))
            for child in node:
                if child.tag != "a":
                    walk(child, path)

        walk(ElementTree.fromstring(page), ())
        ratio = []
        for path, _, _ in leaves:
            same = [x for x in leaves if x[0] == path]
            chars, links, n = sum(len(x[1]) for x in same), sum(x[2] for x in same), len(same)
            marks = sum(x[1].count(",") + x[1].count(".") for x in same)
            ratio.append((chars - links) / n * (1 + marks / n) * (1 - links / chars))
        mean = sum(ratio) / len(ratio)
        bar = min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio)))
        want = set()
        for path in {x[0] for x in leaves}:
            at = [i for i, x in enumerate(leaves) if x[0] == path]
            near = [min(0.25 * ratio[max(i - 1, 0)] + 0.5 * ratio[i] + 0.25 * ratio[min(i + 1, len(ratio) - 1)], 2 * ratio[i]) for i in at]
            if ratio[at[0]] > 0 and sum(near) / len(near) >= bar:
                want |= {leaves[i][1] for i in at}
        found = html.blocks(page)
        keep = html.content_paths(found)
        assert [b.text for b in found] == [x[1] for x in leaves]
        assert {b.text for b in found if b.node.path in keep} == want
