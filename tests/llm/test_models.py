import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import cells, language, lm, mixing, pivots, wrapper
from tests.llm.helpers import corpus, frame

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, seed=0, n=120, dim=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype("f4")
    x[50:80] = x[50] + rng.normal(size=(30, dim)) * 0.1
    x[80:90] = x[80]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(500, None, 1), (501, [None] * dim, 1), (502, [float("nan")] * dim, 1), (503, [float("inf")] * dim, 1), (504, [0.0] * dim, 1), (505, [], 1), (506, [1.0, 2.0], 1), (520, [1.0, 2.1], 1), (None, [float(v) for v in x[0]], 1)]
    return rows, spark.createDataFrame(rows, VECTORS)


def usable(x):
    return x is not None and all(v is not None and math.isfinite(v) for v in x)


@pytest.mark.parametrize("few", [True, False])
def test_top_k_equals_brute_force(spark, monkeypatch, few):
    """Repeated rows and ids, clashing columns, integers beyond doubles; with few: many blocks and parts."""
    if few:
        for name, n in (("CANDIDATES", 16), ("QUERIES", 2), ("CANDIDATE_BLOCKS", 2), ("QUERY_BLOCKS", 1)):
            monkeypatch.setattr(pivots, name, n)
    rows, _ = vectors(spark)
    rows += [(600 + i, [2.0**24 + 8 * i, 2.0**25 + i, 3.0], 0) for i in range(30)] + rows[3:5] + rows[40:41]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "label AS dim", "label AS block", "label AS i", "label AS score", "label AS rank", "label AS id", "label AS x")
    got = collections.defaultdict(list)
    for r in sorted(pivots.top_k(df, F.col("vec_id") % 20 == 0, 5).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = collections.defaultdict(list)
    for q, x, _ in rows:
        if q is not None and q % 20 == 0 and usable(x):
            want[q] += [(-sum(math.floor(64 * float(a)) * math.floor(64 * float(b)) for a, b in zip(np.float32(x), np.float32(y), strict=True)), v) for v, y, _ in rows if v is not None and v != q and usable(y) and len(y) == len(x)]
    assert dict(got) == {q: [(k + 1, v, -s) for k, (s, v) in enumerate(sorted(w)[:5])] for q, w in want.items() if w}


@pytest.mark.parametrize("tile,step,ahead", [(64, 256, 2048), (3, 5, 7)])
def test_bounds_spare_most_candidates_of_clustered_vectors(monkeypatch, tile, step, ahead):
    """Results equal those of looking at all."""
    for name, n in (("TILE", tile), ("STEP", step), ("AHEAD", ahead)):
        monkeypatch.setattr(pivots, name, n)
    rng = np.random.default_rng(5)
    x = np.floor(64 * (rng.normal(size=(40, 64))[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 64)) * 0.02))
    p = x[:64]
    ids, far = np.arange(len(x)), pivots.distances(x, p).astype(np.float32)
    best = pivots.Best(ids[::20], x[::20], far[::20], 20)
    assert pivots.CHEAP < len(p)
    for lo in range(0, len(x), 2000):
        best.meet(ids[lo : lo + 2000], x[lo : lo + 2000], far[lo : lo + 2000])
    assert 0 < best.looked < 0.5 * 300 * 6000
    scores = x[::20] @ x.T
    scores[np.arange(300), ids[::20]] = -np.inf
    order = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    assert (best.found == order).all() and (best.score == np.take_along_axis(scores, order, 1)).all()


def test_search_deals_both_sides_on_a_grid(spark):
    """No join on one key: tasks hold blocks by length, candidate part and query part."""
    _, df = vectors(spark)
    plan = pivots.top_k(df, F.col("vec_id") % 20 == 0)._jdf.queryExecution().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(dim#" in line]
    assert "CoGroupsInArrow" in plan and dealt and all(line.split("hashpartitioning(")[1].split("),")[0].count("#") >= 3 for line in dealt) and "CartesianProduct" not in plan


def test_near_duplicate_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 20)
    monkeypatch.setattr(cells, "LEAST_ROWS", 5)
    monkeypatch.setattr(cells, "TILE_ROWS", 7)
    monkeypatch.setattr(cells, "VISITORS", 4)
    monkeypatch.setattr(cells, "SLICE", 3)
    rows, df = vectors(spark)
    df = df.selectExpr("*", "label AS dim", "label AS rep", "label AS x", "label AS n", "label AS good")  # names that the operator uses inside
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cells.grouped(df).collect()}
    fine = {v: np.array(np.float32(x), float) for v, x, _ in rows if v is not None and usable(x) and any(x)}
    linked = {v: {u for u, y in fine.items() if u != v and len(y) == len(x) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95} for v, x in fine.items()}
    for v, _, _ in rows:
        if v is None:
            assert got[v] == (0, None, False)
            continue
        seen, front = {v}, [v]
        while front:
            front = [u for w in front for u in linked.get(w, ()) if u not in seen and not seen.add(u)]
        assert got[v] == (len(linked.get(v, ())), min(seen), v == min(seen))


def near(x, threshold=0.95):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    return linked


def in_subspace(seed, n, inner, dim=64):
    """Vectors of many dimensions that lie in a few, as those of real texts nearly do."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.qr(rng.normal(size=(dim, inner)))[0]
    return (rng.normal(size=(n, inner)) @ axes.T).astype("f4")


@pytest.mark.parametrize("inner", [3, 4, 6, 8, 64])
def test_no_link_across_cells_is_lost(inner):
    """With the shipped constants: every linked pair meets in a tile, in one only, and few dimensions rule most tiles out."""
    x = in_subspace(inner, 6000, inner).astype(float)
    linked = near(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = cells.fit(x, 24)
    home = np.argmax(x @ c.T, axis=1)
    tiles = cells.Tiles(c, np.bincount(home, minlength=24), np.array([(x @ c.T)[home == i, i].min() for i in range(24)]), 0.95)
    assert len(tiles.starts) > 4
    at_home, visits = np.zeros((len(x), len(tiles.starts)), bool), np.zeros((len(x), len(tiles.starts)), bool)
    for row, tile, own in tiles.of(x, np.arange(len(x))):
        at_home[row[own], tile[own]], visits[row[~own], tile[~own]] = True, True
    assert (at_home.sum(1) == 1).all()
    a, b = np.nonzero(np.triu(linked))
    met = (at_home[a] & (at_home | visits)[b]).sum(1) + (visits[a] & at_home[b]).sum(1)
    assert (met == 1).all() and (len(a) > 500 or inner > 8)
    if inner <= 4:
        assert visits.sum() < 0.6 * len(x) * (len(tiles.starts) - 1) / 2


def test_links_of_many_cells_equal_brute_force(spark):
    """64 dimensions, few of them used, and a third of all rows near copies; shipped constants."""
    x = np.concatenate([in_subspace(1, 2500, 4), in_subspace(2, 1000, 6)])
    x = np.concatenate([x, x[7] + np.random.default_rng(3).normal(size=(1500, 64)).astype("f4") * 0.01, x[:40]])
    linked = near(x.astype(float))
    got = {r.vec_id: r for r in cells.grouped(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)).collect()}
    assert [got[i].n_links for i in range(len(x))] == linked.sum(1).tolist()
    least = np.arange(len(x))
    while True:
        now = np.minimum(least, np.where(linked, least, len(x)).min(1))
        if (now == least).all():
            break
        least = now
    assert [got[i].component_id for i in range(len(x))] == least.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vectors_of_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert pivots.top_k(none, F.col("vec_id") % 20 == 0).count() == 0
    assert cells.grouped(none).count() == 0


def test_lm_scores_equal_brute_force(spark):
    rows = corpus(5) + [(None, "kaban todor", None, None)]
    target = {d for d, *_ in rows if d is not None and d % 4 == 0}
    got = {r.doc_id: r for r in lm.scored(frame(spark, rows), spark.createDataFrame([(d,) for d in [*target, None, 4, 9999]], "doc_id long")).collect()}
    words = [(d, (t or "").encode().lower().split()) for d, t, _, _ in rows]
    count = collections.Counter(w for _, x in words for w in x)
    known = {w for w, c in count.items() if c >= lm.LEAST}
    told = [(d, ["<s>", *(w if w in known else "<u>" for w in x), "</s>"]) for d, x in words if x]

    def model(texts):
        one, two, before = collections.Counter(), collections.Counter(), collections.Counter()
        for x in texts:
            one.update(x[1:])
            two.update(zip(x, x[1:], strict=False))
            before.update(x[:-1])
        return one, two, before

    def p(known_, own, h, w):
        one, two, before = (a - b for a, b in zip(known_, own, strict=True))  # without what the document has counted
        alone = (one[w] + lm.A) / (sum(one.values()) + lm.A * (len(known) + 2))
        return lm.L * two[h, w] / before[h] + (1 - lm.L) * alone if before[h] else alone

    models = model([x for d, x in told if d in target]), model([x for _, x in told])
    for d, x in told:
        own = model([x]) if d in target else model([]), model([x])
        t, b = (-sum(math.log(p(m, o, h, w)) for h, w in zip(x, x[1:], strict=False)) / (len(x) - 1) for m, o in zip(models, own, strict=True))
        assert got[d].n_tokens == len(x) - 1
        assert (got[d].loss_target, got[d].loss_background, got[d].score) == pytest.approx((t, b, t - b))
    for d, x in words:
        if not x:
            assert got[d].score is None and got[d].n_tokens == 0
    assert lm.scored(frame(spark, []), spark.createDataFrame([], "doc_id long")).count() == 0


def test_mix_meets_its_targets(spark):
    docs, labels = frame(spark, corpus(6)), spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    plan = mixing.plan(mixing.weighed(docs, labels)).collect()
    assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, mixing.plan(mixing.weighed(docs, labels)).collect()), key=str)
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in plan:
        assert r.size == size[r.doc_id] and r.taken == r.size * r.copies <= 3 * r.size
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, cap = sum(size.values()), {s: 3 * sum(r.size for r in rs) for s, rs in by.items()}
    share, full = {}, set()
    while True:  # resharing as the contract words it
        left, w = total - sum(cap[s] for s in full), sum(weight[s] for s in by if s not in full)
        share = {s: cap[s] if s in full else left * weight[s] / w for s in by}
        over = {s for s in by if s not in full and share[s] > cap[s]}
        if not over:
            break
        full |= over
    for s, rs in by.items():
        assert all(r.target == pytest.approx(share[s]) and r.source_size == cap[s] // 3 for r in rs)
        assert abs(sum(r.taken for r in rs) - share[s]) <= max(r.size for r in rs)
    mixed = collections.Counter(r.doc_id for r in mixing.mixed(docs, labels).collect())
    assert mixed == {r.doc_id: r.copies for r in plan if r.copies}
    assert mixing.plan(mixing.weighed(frame(spark, []), labels)).count() == 0 and mixing.mixed(frame(spark, []), labels).columns == docs.columns


def test_better_documents_come_first_more_often(spark):
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 2.0).otherwise(0.5).alias("weight"))
    other = spark.range(n, n + 100).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit(100).cast("long").alias("size"), F.lit(1.0).alias("weight"))
    got = mixing.plan(docs.unionByName(other)).filter("source = 'a'")
    share = got.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("copies").alias("c"), F.sum("taken").alias("t")).collect()
    by = {r.odd: r.c for r in share}
    target = got.first().target
    assert by[0] >= by[1] and abs(sum(r.t for r in share) - target) <= 1


def test_ranges_are_even_whatever_the_weights(spark):
    """One source holds nine tenths of the rows, and its weights differ a hundredfold."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"), F.lit(3).cast("long").alias("size"), F.element_at(F.array(F.lit(0.02), F.lit(0.5), F.lit(2.0), F.lit(None), F.lit(0.5)), (F.col("id") % 5 + 1).cast("int")).alias("weight"))
    keys = docs.select(F.concat(F.lit("="), "source").alias("skey"), F.coalesce("weight", F.lit(1.0)).alias("weight"), (-F.log((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) + 0.5) / 1_000_003) / F.coalesce("weight", F.lit(1.0))).alias("key"))
    cut = keys.join(mixing.spreads(keys), "skey").withColumn("cut", F.floor(mixing.share_below(F.col("key"), F.col("mix")) * F.col("ranges")))
    by = cut.groupBy("skey", "cut").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("skey", "cut").collect()
    assert len(by) == 14 + 2 and max(r.n for r in by) < 1.1 * mixing.RANGE_ROWS
    assert all(a.hi <= b.lo for a, b in zip(by, by[1:], strict=False) if a.skey == b.skey)
    assert mixing.plan(docs).filter("source_size IS NULL OR taken > 9").count() == 0


def test_mix_keeps_columns_with_its_own_names(spark):
    docs = frame(spark, corpus(6)).withColumns({c: F.lit(5) for c in ("copies", "copy", "Copy_", "weight", "cut", "target", "mix")})
    out = mixing.mixed(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.columns == docs.columns and out.count() > 0 and out.filter("copies != 5 OR `copy` != 5 OR size != 7").count() == 0


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identified(docs, "lang").filter("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    docs = frame(spark, corpus(7))
    got = {r.doc_id: r for r in language.identified(docs).collect()}
    for d, t, *_ in corpus(7):
        none = t is None or not any(c.isalpha() for c in t)
        assert (got[d].lang_pred == "und") == none and (got[d].score == 0 or not none)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    blind = language.identified(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in blind.collect()} == {"und"}
    swapped = {r.doc_id: r.lang_pred for r in language.predict(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), language.learn(docs)).collect()}
    plain = {r.doc_id: r.lang_pred for r in language.predict(docs, language.learn(docs)).collect()}
    assert swapped == plain
    assert language.identified(frame(spark, [])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href=/a>A<li><a href=/b>B</ul></nav><div id="sidebar">side</div>
%s<div class="cookie-notice">We use cookies</div><form><p>subscribe</p></form><footer>&copy; foot</footer></body></html>"""


def test_pages_without_boilerplate(spark):
    body = "<article><h1>Head&nbsp;line</h1><p>First <b>bo</b>ld &lt;x&gt;\n para<br>next<p>Second<div class='ad'>buy</div><section id=comments><p>I disagree</section></article>"
    plain = "<div class='post'><h2>Head</h2><p>One long enough paragraph of the text.</p><p>Another paragraph, also of the text.</p></div>"
    rows = [(1, "http://h.example/1", PAGE % body), (2, "http://h.example/2", PAGE % plain), (3, None, None), (4, "odd", ""), (5, "http://h.example/1", PAGE % body), (6, "x", "just words"), (7, "y", "<p>un<b>closed")]
    got = {r.page_id: r for r in wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == got[5].text == "Head line First bold <x> para next Second"
    assert got[2].text == "Head One long enough paragraph of the text. Another paragraph, also of the text."
    assert got[3].text == got[4].text == "" and got[6].text == "just words" and got[7].text == "unclosed"
    assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize(
    "body",
    [
        "<main><article><header class='entry-header'><h1>Title here</h1></header><div class='entry-content'><p>Body one.</p><aside>pull</aside><p>Body two.</p></div><footer>tags</footer></article></main><section class='comment-list'><p>no</p></section>",
        "<div class='layout with-sidebar'><div class='sidebar'><p>side</p></div><article class=post><h1>Title here</h1><p>Body one.</p><p>Body two.</p></article></div>",
        "<div class='page-header'><h2>Site</h2></div><div id='content' role='main'><h1>Title here</h1><p>Body one.</p><div class='ad-banner'>buy</div><p>Body two.</p><div id='disqus_thread'>hm</div></div>",
        "<div class='header'><p>Site name and slogan</p></div><div class='col'><div class='text'><h1>Title here</h1><p>Body one.</p><p>Body two.</p></div></div><div class='related'><p>Read also</p></div>",
    ],
)
def test_layouts(body):
    assert wrapper.Wrapper(None).extract(PAGE % body) == "Title here Body one. Body two."


def test_constant_nodes_are_template():
    pages = [PAGE % f"<div class=main><p>Share this story</p><p>Story number {i}, of which every page of the host has its own.</p></div>" for i in range(6)]
    made = wrapper.Wrapper(wrapper.induce(pages))
    assert made.extract(pages[2]) == "Story number 2, of which every page of the host has its own."


def tree(source):
    return wrapper.tree_of(wrapper.blocks(wrapper.parse(source)))


def brute_weight(x, y):
    """Simple tree matching as it is defined."""
    if x.mark != y.mark:
        return 0
    m = [[0] * (len(y.kids) + 1) for _ in range(len(x.kids) + 1)]
    for i, u in enumerate(x.kids):
        for j, v in enumerate(y.kids):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_weight(u, v))
    return 1 + m[-1][-1]


def test_tree_matching_equals_its_definition():
    rng = random.Random(2)

    def grown(deep):
        kids = [grown(deep - 1) for _ in range(rng.randrange(4))] if deep else []
        return wrapper.Tree(rng.choice(["div", "div", "div.a", "section"]), kids, [])

    for _ in range(300):
        x, y = wrapper.Tree("body", [grown(3) for _ in range(3)], []), wrapper.Tree("body", [grown(3) for _ in range(3)], [])
        pairs = wrapper.matching(x, y)
        assert len(pairs) == brute_weight(x, y) and all(u.mark == v.mark for u, v in pairs)
        assert len({id(u) for u, _ in pairs}) == len({id(v) for _, v in pairs}) == len(pairs)
        both = wrapper.written(x)
        wrapper.unite(x, y)
        assert wrapper.written(wrapper.read(wrapper.written(x))) == wrapper.written(x)
        assert len(wrapper.matching(x, wrapper.read(both))) == both.count("[") - 1  # the merged tree holds the first


def test_tree_matching_aligns_inserted_nodes_in_wide_and_deep_pages():
    shapes = [f"<div><section><div class={c}>x</div></section></div>" for c in "abc"]
    wide = lambda extra: "<body>" + "".join(shapes[i % 3] + (extra if i == 70 else "") for i in range(150)) + "<div class=end>y</div>"
    pairs = wrapper.matching(tree(wide("")), tree(wide("<div class=new>z</div>")))
    assert sum(x.mark == "section" for x, _ in pairs) == 150 and any(x.mark == "div.end" for x, _ in pairs)
    deep = "<body>" + "<div>" * 3000 + "text"
    assert len(wrapper.matching(tree(deep), tree(deep + "<section>more"))) == 3002
    assert wrapper.Wrapper(None).extract(deep) == "text"
    assert len(wrapper.preorder(tree("<body>" + "<div><p>x</p></div>" * 5000))) == 4  # a list is one node


NEUTRAL = "<html><body><div><div>%s</div><div>%s</div></div><div><div>%s</div><div>%s</div></div><div>%s</div></body></html>"


def neutral(i, menu="All of our pages, in the order of the alphabet and in that of their dates, are listed here for all of our readers, old and new. " * 4):
    """A page without any telling name: menu, teaser of the day, article, what three readers of some pages wrote, imprint."""
    story = f"<div>Story {i} begins in the town of number {i}, as none of the others does.</div><div>Then story {i} goes on.</div>" + f"<div>And on, for the {i}th time.</div>" * (i % 3)
    voices = "".join(f"<div>Reader {i}.{k} disagrees with what page {i} says about it all.</div>" for k in range(2)) if i % 4 == 0 else ""
    return NEUTRAL % (menu, f"Teaser of day {i % 2}: " + "come and see what is new with us today. " * 3, story, voices, "Imprint: " + "a long and lawful statement. " * 12)


def stories(i):
    return f"Story {i} begins in the town of number {i}, as none of the others does. Then story {i} goes on." + f" And on, for the {i}th time." * (i % 3)


def test_the_wrapper_decides_where_names_tell_nothing(spark):
    rows = [(i, "http://n.example/", neutral(i)) for i in range(24)]
    made = wrapper.Wrapper(wrapper.induce([x for *_, x in rows]))
    assert [made.extract(x) for *_, x in rows] == [stories(i) for i in range(24)]
    alone = [wrapper.Wrapper(None).extract(x) for *_, x in rows]
    assert not any(a == stories(i) for i, a in enumerate(alone))  # without it no page comes out right
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: stories(i) for i in range(24)}


@pytest.mark.parametrize("fan,size", [(64, 8_000_000), (2, 0)])
def test_wrappers_equal_those_of_one_task(spark, monkeypatch, fan, size):
    """Several hosts and layouts, merged in one round and in many, broadcast and joined by salt; clashing columns, a long page."""
    monkeypatch.setattr(wrapper, "FAN", fan)
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", size)
    story = lambda i: f"<p>Story {i} begins, as none of the others does, in the town of number {i}.</p><p>Story {i} ends.</p>"
    of = {"n.example": [neutral(i) for i in range(9)], "h.example": [PAGE % f"<div class=a{'' if i < 8 else ' b'}><p>Printed on plain paper</p>{story(i)}{'<section><h2>More</h2></section>' * (i % 3)}</div>" for i in range(14)], "l.example": [PAGE % f"<article>{story(0) * 4000}</article>"]}
    rows = [(k * 100 + i, f"https://{host}/{i}", x, "t") for k, (host, pages) in enumerate(of.items()) for i, x in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").selectExpr("*", "host AS salt", "host AS wrapper", "host AS text", "host AS tree")
    got = {r.page_id: r for r in wrapper.extracted(df).collect()}
    want = {h: wrapper.Wrapper(wrapper.induce(pages)) for h, pages in of.items()}
    assert {k: r.text for k, r in got.items()} == {k: want[u.split("/")[2]].extract(x) for k, u, x, _ in rows}
    assert got[200].n_chars > 300_000 and got[100].text.startswith("Story 0 begins")


STORY = "<h1>On %d</h1><p>What is said on page %d is said on no other page of this host.</p>"


@pytest.mark.parametrize(
    "inside,kept",
    [
        ("<div class='tags'>rare words</div>", "rare words"),
        ("<div class='legal'>A lawyer writes</div>", "A lawyer writes"),
        ("<div class='share-price'>The share stood at 12</div>", "The share stood at 12"),
        ("<p>Opening hours are nine to five.</p>", "Opening hours are nine to five."),
        ("<div class='notice-board'><p>Pinned up</p></div>", "Pinned up"),
        ("<div style='overflow: hidden' data-id=ad aria-hidden=false data-class='comments'><p>Shown</p></div><div hidden><p>not</p></div>", "Shown"),
        ("<div class='ad'>buy</div><div id='comments'><p>I disagree</p></div><form><p>Name</p></form><aside>x</aside>", ""),
    ],
)
def test_articles_lose_nothing_but_what_names_set_apart(inside, kept):
    pages = [PAGE % f"<article>{STORY % (i, i)}{inside}<p>End {i}.</p></article>" for i in range(8)]
    made = wrapper.Wrapper(wrapper.induce(pages))
    want = lambda i: " ".join(f"On {i} What is said on page {i} is said on no other page of this host. {kept} End {i}.".split())
    assert [made.extract(x) for x in pages] == [want(i) for i in range(8)] == [wrapper.Wrapper(None).extract(x) for x in pages]


def test_all_articles_of_a_page_and_one_article_on_many_pages():
    two = [PAGE % f"<article>{STORY % (i, i)}</article><article><p>A second piece on {i}.</p></article>" for i in range(6)]
    assert [x[-20:] for x in map(wrapper.Wrapper(wrapper.induce(two)).extract, two)] == [f"A second piece on {i}."[-20:] for i in range(6)]
    recipe = "<p>Take two eggs and a pound of flour, and stir them well before you bake them.</p><p>Serve hot.</p>"
    for frame_ in ("<article>%s</article>", "<div class=main>%s</div>"):
        same = [PAGE % (f"<p>May {i}</p>" + frame_ % recipe) for i in range(6)]
        assert {wrapper.Wrapper(wrapper.induce(same)).extract(x) for x in same} == {"Take two eggs and a pound of flour, and stir them well before you bake them. Serve hot."}


def test_whole_test_table_of_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*)</article>", r.html, re.S)[1])).split()) for r in pages.collect()}
    assert {r.page_id: r.text for r in wrapper.extracted(pages).collect()} == want
    assert wrapper.extracted(pages.limit(0)).count() == 0


def test_template_of_every_layout_and_no_article_of_copies(spark):
    """One host: 40 pages of a layout, 8 of another one with its own boilerplate, and 30 copies of one article under other dates."""
    story = lambda i: f"<p>Story {i} begins, as none of the others does, in the town of number {i}.</p><p>Story {i} goes on here and then it ends.</p>"
    rows = [(i, "http://h.example/", PAGE % f"<div class=a><p>Printed on plain paper</p>{story(i)}</div>") for i in range(40)]
    rows += [(i, "http://h.example/", PAGE % f"<div class=b><div class=c><p>From our own desk</p>{story(i)}</div></div>") for i in range(40, 48)]
    rows += [(i, "http://k.example/", PAGE % f"<div class=a><p>May {i}</p>{story(7)}</div>") for i in range(50, 80)]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda i: f"Story {i} begins, as none of the others does, in the town of number {i}. Story {i} goes on here and then it ends."
    assert got == {i: text(i) if i < 48 else f"May {i} {text(7)}" for i, _, _ in rows}


def test_content_path_is_the_block_of_slot_text(spark):
    """Neither comments that some pages have nor teasers that come again are the text, however long they are."""
    story = lambda i: f"Story {i} is short, but no other page of the host has it, and so it is the text of page {i}."
    talk = lambda i: "".join(f"<li>Reader {i}.{k} has a lot to say about what page {i} told, and says it at some length.</li>" for k in range(5))
    teasers = "".join(f"<p>Elsewhere, number {k}: the same few lines stand on half of all pages, and they are as long as they can be.</p>" for k in range(4))
    page = lambda i: PAGE % f"<div class=a><p>{story(i)}</p></div><ul class=voices>{talk(i) if i % 3 == 0 else ''}</ul><div class=more>{teasers if i % 2 else ''}</div>"
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame([(i, "http://h.example/", page(i)) for i in range(12)], "page_id long, url string, html string")).collect()}
    assert got == {i: story(i) for i in range(12)}
    made = wrapper.Wrapper(wrapper.induce([page(i) for i in range(12)]))
    assert made.host.nodes[max(made.value, key=made.value.get)].mark == "div.a"
