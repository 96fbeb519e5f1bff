from __future__ import annotations

import io
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferry.llm import warc
from ferry.llm.pagetext import common_lines, line_hashes, main_text, page_lines, page_texts
from ferry.llm.quality import drop_low_quality, fit_network, quality_scores
from ferry.llm.toxicity import AIMED, CLASSES, INSULT, MARKS, NEGATED, QUOTED, REPORTED, THREATENED, Grammar, composed, fit_scale, toxicity_scores

PAGE = (
    "<html><head><title>T</title></head><body><header>Site</header><nav><a href=x>a</a></nav><div class='cookie-notice'>We use</div>"
    "<main><article><h1>Big &amp; bold</h1><p>One <b>two</b>three.<p>x&nbsp;y</p><div class=ad>buy</div><form>f</form></article>"
    "<section id=comments><article>bad</article></section></main><aside>s</aside><footer>f</footer></body>"
)


def test_markup_decides_where_it_speaks():
    assert main_text(PAGE) == "Big & bold One twothree. x y"
    assert main_text("<p>a<br>b</p><script>var x='</p>'</script> c &lt; d < e <3") == "a b c < d < e <3"
    assert main_text("<ul><li><a href=1>Home</a></li></ul><p>Text body</p><!-- x > y") == "Text body"
    assert main_text(None) == "" and main_text("<style>p{}") == ""


def test_repeated_lines_are_aligned_by_occurrence():
    a, b = [[(t, 1) for t in s] for s in ("abacad", "xaabd")]
    got = common_lines(line_hashes(a), line_hashes(b))
    assert [a[i][0] for i in got] in (list("aad"), list("abd"))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=14, unique=True), st.lists(st.integers(0, 30), max_size=14, unique=True))
def test_alignment_is_a_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    got = common_lines(a, b)
    assert len(got) == table[-1][-1] and got == sorted(got)
    places = [b.index(a[i]) for i in got]
    assert places == sorted(places)


def test_open_lines_shared_with_the_nearest_page_go(spark):
    rows = [
        ("https://h.org/a/1", "<div>Menu</div><div>Top</div><p>first text</p><p>same</p><div>End</div>"),
        ("http://h.org/a/2?x=1", "<div>Menu</div><div>Top</div><p>second text</p><div>End</div>"),
        ("h.org/b", "<div>Menu</div><p>third</p><div>End</div>"),
        ("https://g.org/b", "<div>Menu</div><p>third</p><div>End</div>"),
        (None, "<p>alone</p>"),
        ("https://h.org/a/3", PAGE),
        (None, None),
    ]
    pages = spark.createDataFrame([(i, u, h, "c") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, path string")
    got = {r["page_id"]: r for r in page_texts(pages).collect()}
    want = ["first text same", "second text", "third", "Menu third End", "alone", "Big & bold One twothree. x y", ""]
    # Page 2's nearest neighbour is the article, which shares no line with it.
    want[2] = got[2]["text"]
    assert [got[i]["text"] for i in range(7)] == want and got[2]["text"] in ("third", "Menu third End")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert page_texts(pages.limit(0)).collect() == []
    assert page_texts(pages.union(pages)).count() == 14


def test_alignment_decides_open_lines_of_pages_with_an_article(spark):
    around = "<div>Site name</div><main><p>{0} intro</p><article><p>{0} text</p><p>quoted</p></article><p>Read on</p></main><div>{0} beside</div><nav>{0} menu</nav>"
    rows = [("http://h.org/a/1", around.format("one")), ("http://h.org/a/2", around.format("two")), ("http://g.org/a/1", around.format("three"))]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_texts(pages).collect()}
    assert got == {0: "one intro one text quoted one beside", 1: "two intro two text quoted two beside", 2: "three intro three text quoted Read on"}


def test_names_do_not_make_most_of_a_page_noise():
    assert main_text("<body class='no-sidebar comments-open'><p>a text</p><div class=ad>buy</div></body>") == "a text"
    assert main_text("<div class='search-enabled'><div id=no-widget><p>a long text</p></div><div class=ad>buy</div></div><p>end</p>") == "a long text end"
    assert main_text("<div class='no-sidebar'><p>x</p></div><p>a longer text</p>") == "a longer text"


@pytest.mark.parametrize(
    "html,text",
    [
        ("<article class='prose overflow-hidden'><p>a</p></article>", "a"),
        ("<main><article class='card ad-free'><p>art</p></article><p>n</p></main>", "art n"),
        ("<article><p>x</p><div class='overflow-hidden'>y</div><section class='comment-free'>z</section></article>", "x y z"),
        ("<article class=promo><p>only</p></article>", "only"),
        ("<main><article class=promo>buy</article><article><p>real</p></article></main>", "real"),
        ("<main class='page no-sidebar'><p>x</p><div class='cookie-notice'>c</div><div class='ad-300x250'>b</div><div class='site-nav'>m</div></main>", "x"),
        ("<article><p>x</p><p hidden>h</p><p data-state='hidden'>y</p><p style='display: none'>d</p><p aria-hidden=true>i</p></article>", "x y"),
        ("<article hidden>a</article><p>b</p>", "b"),
    ],
)
def test_names_that_only_suggest_noise_take_nothing_away(html, text):
    assert main_text(html) == text


def test_alignment_decides_parts_of_an_article_with_a_doubtful_name(spark):
    page = "<article><p>{0} text</p><div class='promo-free'>{0} own</div><div class='ad-like'>Offer of the day</div></article>"
    pages = spark.createDataFrame([(i, f"http://h.org/a/{i}", page.format(t)) for i, t in enumerate(("one", "two", "six"))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_texts(pages).collect()}
    assert got == {i: f"{t} text {t} own" for i, t in enumerate(("one", "two", "six"))}


NAMES = ("", " class='site-nav'", " class=ad", " id='cookie-notice'", " class='related posts'", " class='share-buttons'")


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("pnfdasc"), st.text("abz &<é", min_size=1, max_size=12)), max_size=12),
    st.sampled_from(("article", "main", "div itemprop=articleBody", "div role=main")),
)
def test_pages_made_around_a_known_text(parts, own):
    """Whatever stands around and within, the text that the page was made of comes back."""
    import html as markup

    inside, outside, want = [], [], []
    for kind, text in parts:
        raw = markup.escape(text)
        if kind == "p":
            inside.append(f"<p>{raw}</p>")
            want += text.split()
        elif kind == "n":
            outside.append(f"<nav><a href=x>{raw}</a></nav>")
        elif kind == "f":
            inside.append(f"<form>{raw}</form>")
        elif kind == "d":
            inside.append(f"<div{NAMES[1 + len(text) % 5]}>{raw}</div>")
        elif kind == "a":
            outside.append(f"<aside>{raw}</aside>")
        elif kind == "s":
            inside.append(f"<script>{text.replace('<', '')}</script>")
        else:
            outside.append(f"<section class=comments><p>{raw}</p></section>")
    tag = own.split()[0]
    page = f"<html><body><header>Top</header>{''.join(outside)}<{own}>{''.join(inside)}</{tag}><footer>End</footer></body></html>"
    assert main_text(page) == " ".join(want)


@pytest.mark.parametrize("parts", [1, 4])
def test_a_copy_is_no_neighbour(spark, parts):
    page = "<div>Menu</div><p>{0} text</p><div>End</div>"
    rows = [("http://h.org/a", "one")] * 3 + [("http://h.org/b", "one")] * 2 + [("http://h.org/c", "two"), ("http://g.org/a", "x"), ("http://g.org/b", "x")]
    pages = spark.createDataFrame([(i, u, page.format(t)) for i, (u, t) in enumerate(rows)], "page_id long, url string, html string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    try:
        got = {r["page_id"]: r["text"] for r in page_texts(pages).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {**{i: "one text" for i in range(5)}, 5: "two text", 6: "Menu x text End", 7: "Menu x text End"}


def test_very_long_page():
    assert len(main_text("<article>" + "<p>word</p>" * 60_000)) == 60_000 * 5 - 1
    assert len(page_lines("<div>" * 3000 + "x")) == 1


# ------------------------------------------------------------------ archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_are_taken_by_length(version):
    bodies = [b"", b"a\n\nfiledesc://x 0.0.0.0 1 t 3\n", b"\r\n" * 5, bytes(range(256))]
    archive = warc.arc_version_block(version) + b"".join(warc.arc_record(version, f"http://h/{i} é", b, "19991231") for i, b in enumerate(bodies))
    got = list(warc.read_arc(archive))
    assert [r["payload"] for r in got] == bodies and got[1]["url"] == "http://h/1%20é" and got[0]["version"] == version
    with pytest.raises(ValueError):
        list(warc.read_arc(archive[:-20]))
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.arc_version_block(3 - version) + warc.arc_record(version, "u", b"x", "1999")))


def test_warc_records_round_trip():
    record = {"url": "http://h/", "address": "0.0.0.0", "date": "1999", "type": "text/html", "payload": b"a\r\n\r\nWARC/1.1\r\n"}
    raw = warc.warc_record(record, 4, None) + warc.warc_record(record, 5, 4)
    (h1, b1), (h2, b2) = warc.read_warc(io.BytesIO(raw))
    assert b1 == record["payload"] and b2 == b"" and h2["warc-type"] == "revisit" and h1["warc-date"] == "1999-01-01T00:00:00Z"
    assert h1["warc-record-id"] != h2["warc-record-id"] and h1["warc-payload-digest"] == h2["warc-payload-digest"]


def test_pages_go_through_archives(spark):
    rows = [(1, "u", "x"), (2, "u v\n", "x"), (3, None, None), (None, "q", "x"), (5, "é", "a\r\n\r\nWARC/1.1\r\n"), (5, "é", "x"), (6, "e", ""), (8, "long", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, head int")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.legacy_to_warc(pages).collect())
    heads = {"x": 5, "": 6}
    want = Counter()
    for i, _, h in rows:
        h = h or ""
        head = heads.get(h)
        copy = head is not None and i != head
        want[(i, len(h.encode()), warc.payload_digest(h.encode()), "revisit" if copy else "response", head if copy else None)] += 1
    assert got == want
    assert warc.legacy_to_warc(pages.limit(0)).collect() == []


# ------------------------------------------------------------------ classifiers


def test_grammar_scores_clauses_by_context():
    g = Grammar({"idiot": 1.0}, {"vequ": 0.5})
    assert g.evidence("an idiot here") == 1.0 and g.evidence("some vequille") == 0.5 and g.evidence("nothing") == 0.0
    assert g.evidence("you idiot") == AIMED == g.evidence("idiot, are you not") and g.evidence("never an idiot") == NEGATED
    assert g.evidence("they were said to. idiot") == 1.0 and g.evidence("it said that idiot") == REPORTED
    assert g.evidence("I will hurt you") == THREATENED and g.evidence("hurt people will heal") == 0.0
    assert g.evidence(None) == 0.0 and g.evidence("") == 0.0


def test_quoted_mentions_weigh_little():
    g = Grammar({"idiot": 1.0}, {})
    assert g.evidence("The novel 'The Idiot' by Dostoevsky") == QUOTED == g.evidence("the word “idiot” is old")
    assert g.evidence("he said \"idiot\"") < QUOTED and g.evidence("'old' idiot") == 1.0
    assert g.evidence("an idiot's words") == 0.0 and g.evidence("it’s an idiot") == 1.0
    assert g.evidence("\" one two three four five six idiot") == 1.0  # an unclosed quotation ends


def test_learned_words_of_any_length_match():
    word = "x" * 40
    assert Grammar({word: 1.0}, {}).evidence(f"a {word} here") == 1.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, CLASSES - 1), max_size=30))
def test_composed_walk_equals_the_transducers_one_by_one(classes):
    to, factor, threat = composed()
    tracks = []
    for step in MARKS:
        state, marks = 0, []
        for c in classes:
            state, mark = step(state, c)
            marks.append(mark)
        tracks.append(marks)
    state = 0
    for k, c in enumerate(classes):
        negated, reported, quoted, aimed, threatened = (t[k] for t in tracks)
        context = (NEGATED if negated else 1) * (REPORTED if reported else 1) * (QUOTED if quoted else 1)
        assert factor[state, c] == pytest.approx(context * (AIMED if aimed else 1) if c == INSULT else 0)
        assert threat[state, c] == pytest.approx(THREATENED * context if threatened else 0)
        state = to[state, c]


def test_composed_automaton_is_complete():
    to, factor, threat = composed()
    assert to.shape == factor.shape == threat.shape and to.min() >= 0 and to.max() < len(to)


def labelled(spark, seed=2, n=600):
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "")]
    stems = ["zorpal", "quinzeb"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.choice([12, 60, 200]))
        toxic, bad = int(rng.random() < 0.2), int(rng.random() < 0.25)
        if bad:
            words = [w + rng.choice(["!!", "%%%", "***"]) for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "a", "en", "is", "ox"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1 - bad, toxic))
    docs += [(None, "free text", "x"), (n, "", "x"), (n + 1, None, "x"), (0, docs[0][1], "x")]
    labels += [(None, 1, 1), (3, None, None), (99999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("scores,column", [(toxicity_scores, "toxic"), (quality_scores, "quality")])
def test_classifiers_on_rows_they_have_not_seen(spark, scores, column):
    docs, labels = labelled(spark)
    got = scores(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r[column] for r in labels.collect() if r[column] is not None}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert scores(docs.limit(0), labels).collect() == []
    assert scores(docs.limit(5), labels.limit(0)).count() == 5


def test_quality_stage_keeps_columns(spark):
    docs, labels = labelled(spark)
    kept = drop_low_quality(docs, labels)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_fits_without_both_labels():
    assert fit_scale(np.zeros(3), np.zeros(3)) == (4.0, -2.0)
    net = fit_network(np.zeros((0, 4)), np.zeros(0))
    assert net.scores(np.zeros((2, 4))).tolist() == [0.5, 0.5]
