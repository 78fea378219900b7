"""Bounds that rule pairs out early lose nothing; fitting takes all candidates; no step of a method is left out."""

import zlib

import numpy as np

from plumbline.llm import jaccard_join, maxent, page_diff, private_spans


def test_cross_pairs_by_place(spark):
    """Pairs whose token stands too far back, or whose sizes differ too much, are not made; others all are."""
    places = [(1, 100, 3), (2, 100, 5), (3, 100, 14), (4, 60, 2), (5, 110, 1)]
    nodes = spark.createDataFrame([(k, n, [*range(1000 * k, 1000 * k + at - 1), 77]) for k, n, at in places], "node long, n long, singles array<long>")
    rest = spark.createDataFrame([(77, k, k) for k, _, _ in places], "key long, node long, component long")
    got = {(r["u"], r["v"]) for r in jaccard_join._cross_pairs(rest, nodes, 85).collect()}
    want = set()
    for a, n, i in places:
        for b, m, j in places:
            most = min(n - i + 1, m - j + 1)
            if a < b and 100 * most >= 85 * (n + m - most):
                want.add((a, b))
    assert got == want and (1, 2) in got and (1, 3) not in got and (1, 4) not in got


def test_private_fit_takes_all_candidates(spark, monkeypatch):
    seen = []

    class Watched(private_spans.GBTClassifier):
        def fit(self, dataset, params=None):
            seen.append(dataset.count())
            return super().fit(dataset, params)

    monkeypatch.setattr(private_spans, "GBTClassifier", Watched)
    rows = [(k, f"write to a{k}@b.example now" if k % 2 else f"call (555) 010-{k:05d} now") for k in range(7000)]
    private_spans.find(spark.createDataFrame(rows, "doc_id bigint, text string")).count()
    assert len(seen) == 1 and seen[0] > 4500
    for kept in list(spark.sparkContext._jsc.getPersistentRDDs().values()):  # Spark ML leaves some to the garbage collector
        kept.unpersist()


def test_cross_pairs_are_not_broadcast(spark):
    """Entries of lists grow with the table, so they don't go through the driver."""
    nodes = spark.createDataFrame([(k, 10, [77]) for k in range(4)], "node long, n long, singles array<long>")
    rest = spark.createDataFrame([(77, k, k) for k in range(4)], "key long, node long, component long")
    met = []
    cut = jaccard_join.cut_lineage
    try:
        jaccard_join.cut_lineage = lambda df: met.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df)
        jaccard_join._cross_pairs(rest, nodes, 85)
    finally:
        jaccard_join.cut_lineage = cut
    assert "Broadcast" not in met[0]


def test_maxent_words_depend_on_the_last_word(spark):
    """Chances of all tokens add up to one after any words, follow the last word inside a class, and beat word counts on other texts."""
    rng = np.random.default_rng(5)
    heads, tails = [f"h{k}" for k in range(40)], [f"t{k}" for k in range(40)]
    text = lambda: " ".join(f"{heads[k]} {tails[k]}" for k in rng.integers(0, 40, 30))
    docs = spark.createDataFrame([(k, text()) for k in range(300)], "doc_id long, text string")
    model = maxent.fit(docs, top=70)
    words = model.words.tolist()
    for start in (b"h3", b"h7 t7", b"unknown", b""):
        before, _ = maxent.word_hashes([start])
        chances = []
        for token in [*words, int(maxent.END), 12345]:  # the last is beyond the top: its class stands for all such words
            tokens = np.append(before, np.uint64(token))
            at, known = maxent._known(model, tokens)
            chances.append(np.exp(maxent._log_chances(model, tokens, np.array([len(tokens)]), at, known)[-1]))
        assert abs(sum(chances) - 1) < 1e-5
    rows = maxent.score(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r["id"]).encode()) % 7 == 2]
    assert held and sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)
    # a pair of words in one class: each is likelier after its own head
    classes = dict(zip(words, model.classes.tolist()))
    tail_of = {k: int(maxent.word_hashes([f"t{k}".encode()])[0][0]) for k in range(40)}
    a, b = next((a, b) for a in range(40) for b in range(a + 1, 40) if classes.get(tail_of[a], -1) == classes.get(tail_of[b], -2))

    def gain(head: int, tail: int) -> float:
        tokens = np.append(maxent.word_hashes([f"h{head}".encode()])[0], np.uint64(tail_of[tail]))
        at, known = maxent._known(model, tokens)
        return maxent._log_chances(model, tokens, np.array([2]), at, known)[-1]

    assert gain(a, a) > gain(a, b) + 1 and gain(b, b) > gain(b, a) + 1


def test_page_differencing_steps_past_copies(spark):
    """A large menu does not make pages copies; equal pages count once; copies make room for the next nearest page."""
    page = "<body>" + "".join(f"<div>Menu entry {k}</div>" for k in range(9)) + "{}</body>"
    menus = [(k, f"http://m.example/{k}", page.format(f"<p>the own text of page number {k}, which is long enough</p>")) for k in range(5)]
    story = "".join(f"<p>paragraph {k} of the story that was printed twice</p>" for k in range(9))
    same = [(100 + k, f"http://c.example/a{k:02d}", page.format(story)) for k in range(30)]
    near = [(200 + k, f"http://c.example/b{k}", page.format(story + f"<p>printed again on day {k}</p>")) for k in range(4)]
    other = [(300 + k, f"http://c.example/c{k}", page.format(f"<p>something else altogether {k} here</p>")) for k in range(8)]
    got = page_diff.extract(spark.createDataFrame(menus + same + near + other, "page_id bigint, url string, html string"))
    text = {r["page_id"]: r["main_text"] for r in got.collect()}
    whole = "\n\n".join(f"paragraph {k} of the story that was printed twice" for k in range(9))
    assert all(text[k] == f"the own text of page number {k}, which is long enough" for k in range(5))
    assert all(text[100 + k] == whole for k in range(30))
    assert all(text[200 + k] == whole + f"\n\nprinted again on day {k}" for k in range(4))
    assert all(text[300 + k] == f"something else altogether {k} here" for k in range(8))


def test_page_differencing_inside_articles(spark):
    """A notice that the articles of a host repeat goes; a passage of two articles, copies and articles of template lines alone stay whole."""
    page = "<article><h1>Title {0}</h1><p>the long own text of the article with number {0}</p>{1}</article>"
    story = "".join(f"<p>paragraph {k} of the story</p>" for k in range(6))
    rows = [(k, f"http://n.example/{k}", page.format(k, "<p>sign up for our letter</p>")) for k in range(6)]
    rows += [(10 + k, f"http://p.example/{k}", page.format(k, "<p>a quoted passage</p>" if k < 2 else "")) for k in range(6)]
    rows += [(20 + k, f"http://c.example/{k}", page.format(7, story + f"<p>day {k}</p>")) for k in range(4)]
    rows += [(40 + k, f"http://c.example/x{k}", page.format(40 + k, "")) for k in range(8)]
    rows += [(30, "http://n.example/3b", "<div>Home</div><article><p>sign up for our letter</p></article>")]
    got = page_diff.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    text = {r["page_id"]: r["main_text"].split("\n\n") for r in got.collect()}
    own = lambda k: [f"Title {k}", f"the long own text of the article with number {k}"]
    assert all(text[k] == own(k) for k in range(6))
    assert all(text[10 + k] == own(k) + ["a quoted passage"] * (k < 2) for k in range(6))
    assert all(text[20 + k] == own(7) + [f"paragraph {j} of the story" for j in range(6)] + [f"day {k}"] for k in range(4))
    assert all(text[40 + k] == own(40 + k) for k in range(8))
    assert text[30] == ["sign up for our letter"]
