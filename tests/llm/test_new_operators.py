"""Hard negatives, page extraction and prefix tries against brute force; odd rows; the pipeline and its stages."""

import hashlib
import itertools
import random
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codonloom.llm import chat, common, extraction, jaccard, language, media, mixing, negatives, packing, topk, toxicity, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({schema})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return names, sorted(map(str, found.fetchall()))


def same(df, sql, **tables):
    names, want = by_sql(sql, **tables)
    assert sorted(str(tuple(r[n] for n in names)) for r in df.collect()) == want
    return len(want)


def vectors(n=400, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(0, 0.1, (n, dims)).astype(np.float32)
    m[7], m[8] = m[3], m[3]  # ties
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(m)]
    return rows + [(1000, None, 1), (1050, [0.1, None], 1), (1100, [float("nan")] * 3, 0), (1150, [0.5] * dims, None), (None, [0.5] * dims, 1), (50, [0.9] * dims, 2), (50, [0.9] * dims, 2), (1200, [0.5], 0)]


def test_negatives_equal_sql(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1)).withColumn("v", F.lit("clash"))
    padded = [(i, None if v is None else v if len(v) != 1 else v + [0.0] * 7, x) for i, v, x in rows]
    assert same(negatives.mine(negatives.labelled(df)), negatives.OP11_SQL, embeddings=("vec_id BIGINT, embedding FLOAT[], label INTEGER", padded)) > 20
    assert negatives.mine(negatives.labelled(df.limit(0))).count() == 0


@pytest.mark.parametrize("scale", [1, 2**20, 2**34])
def test_vertical_scans_find_the_exact_windows(scale):
    rng = np.random.default_rng(0)
    m, labels = np.floor(rng.normal(0, 32, (900, 24))).astype(np.int64) * scale, rng.integers(0, 3, 900)
    blocks = []
    for at in range(0, 900, 300):
        ids = np.arange(at, at + 300)
        ids = ids[np.lexsort((ids, labels[ids]))]
        c = m[ids].T
        blocks.append(negatives.Block({"ids": ids.tobytes(), "labels": labels[ids].tobytes(), "columns": [x.tobytes() for x in np.ascontiguousarray(c)], "lows": c.min(1).tobytes(), "highs": c.max(1).tobytes()}))
    read = whole = 0
    for a in range(0, 900, 90):
        scores = (m.astype(object) @ m[a].astype(object)).tolist()
        best = negatives.Best(5)
        for b in blocks:
            read, whole = read + negatives.positives_in(b, a, labels[a], m[a], best), whole + 24 * len(b.same(labels[a]))
        assert best.ids.tolist() == sorted((i for i in range(900) if i != a and labels[i] == labels[a]), key=lambda i: (-scores[i], i))[:5]
        windows = {w: negatives.Best(3) for w in map(negatives.window, map(int, best.scores))}
        for b in blocks:
            read, whole = read + negatives.negatives_in(b, labels[a], m[a], windows), whole + 24 * len(b.other(labels[a]))
        for (low, high), found in windows.items():
            assert found.ids.tolist() == sorted((i for i in range(900) if labels[i] != labels[a] and low <= scores[i] <= high), key=lambda i: (-scores[i], i))[:3]
    assert read < whole


def test_scores_beyond_a_long_are_errors(spark):
    huge = spark.createDataFrame([(0, [1e9, 1e9], 0), (1, [1e9, 1e9], 1)], "vec_id long, embedding array<double>, label int")
    for make in (lambda: negatives.mine(negatives.labelled(huge)).collect(), lambda: topk.search(topk.blocks_of(topk.quantised(huge)), topk.quantised(huge)).collect()):
        with pytest.raises(Exception, match="does not fit a long"):
            make()
    with pytest.raises(Exception, match="out of range"):
        topk.quantised(huge.withColumn("embedding", F.array(F.lit(1e30)))).collect()
    large = spark.createDataFrame([(0, [1e7, 3.0]), (1, [1e6, 5.0])], "vec_id long, embedding array<double>")
    q = topk.quantised(large)
    assert [r["score"] for r in topk.search(topk.blocks_of(q), q.filter("vec_id = 0")).collect()] == [2560000000 * 256000000 + 768 * 1280]


def test_smallest_cut_equals_all_labellings():
    random.seed(1)
    for dense in (False, True):
        for _ in range(300):
            n = random.randint(1, 9)
            costs = [random.randint(-4, 4) for _ in range(n)]
            edges = [(a, b, random.randint(0, 4)) for a in range(n) for b in range(a) if dense or random.random() < 0.3]
            paid = lambda l: sum(max(c, 0) if not x else max(-c, 0) for c, x in zip(costs, l)) + sum(w for a, b, w in edges if l[a] != l[b])  # noqa: B023,E731
            assert paid(extraction.smallest_cut(costs, edges)) == min(map(paid, itertools.product([False, True], repeat=n)))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h2>Site</h2></header><div id="cookie-notice">We use cookies</div>
<nav><ul><li><a href="/a>b">A</a><li>B</ul></nav><form><input><label>Mail</label></form><article><header><h1>Title&nbsp;here</h1></header><p>One  <b>two</b>
three<br>four<p>Five &lt;six&gt; &am<aside>no</aside><div class="ad">buy</div><ul><li>x<li>y</ul><script>if(a<b){"</p>"}</script><button>Share</button>
<section class="comments"><h2>Comments</h2><article><p>great!</p></article></section><article>me too</article><footer>by me</footer></article><aside>side</aside><footer>&copy; z</footer>tail"""
PLAIN = "<body><div class='menu'><a href=x>Home</a></div><div class=content><p>The text of a page, in a sentence.</p><div>Another one.</div></div><div id=sidebar>Links</div></body>"


def test_extraction_of_articles_and_odd_pages(spark):
    rows = [(1, "u", PAGE), (2, None, PLAIN), (3, "u", None), (4, "u", ""), (None, "u", "<article>a &amp; b"), (5, "u", "<a <b"), (5, "u", "<a <b"), (6, "u", "<article>" + "<p>long text " * 3000), (7, "u", "just text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    model = extraction.fit(df)
    found = extraction.extract(df, model).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert texts[1] == "Title here\nOne two three four\nFive <six> &am\nx\ny"
    assert texts[2] == "The text of a page, in a sentence.\nAnother one." and texts[3] == texts[4] == texts[5] == "" and texts[None] == "a & b"
    assert texts[6] == "\n".join(["long text"] * 3000)
    assert extraction.extract(df.limit(0), extraction.fit(df.limit(0))).count() == 0


def test_extraction_stays_linear():
    for s in ("<a " * 50000, '<a "x>' * 30000, "<div>" * 50000 + "x", "&am" * 50000, "<li>x" * 20000, "<script>" * 30000):
        blocks = extraction.Blocks(s)
        assert len(extraction.label(blocks, {})) == len(blocks.texts)


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 140), -5, 205, 250, 299]:
        n = rng.choice([0, 1, 2, 3, 4, 7, 9]) if c % 7 else 3
        rows += [(c, t, ["user", "assistant"][t % 2], rng.choice(["a", "bb", "ccc", "", None])) for t in range(n)]
    rows += [(600, None, None, "null turn"), (600, 1, "user", "x"), (600, 1, "user", "x"), (600, 1, "assistant", "y"), (None, 1, "user", "lost")]
    rows += [(300, t, "user", f"w{t % 3}") for t in range(120)]
    return rows


@pytest.mark.parametrize("chunk,most", [(500_000, 50_000), (7, 4)])
def test_trie_equals_sql(spark, monkeypatch, chunk, most):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("clash")).repartition(4)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "IDS", 3)
    ranked = trie.ranked
    monkeypatch.setattr(trie, "ranked", lambda items: ranked(items, most))
    same(trie.trie(df), trie.OP13_SQL, conversations=("conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR", rows))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    (root,) = trie.trie(spark.createDataFrame([(lone, 0, "user", "gone")], TURNS)).collect()
    assert (root["conv_id"], root["depth"], root["n_convs"], root["n_leaves"], root["ends_sha256"]) == (lone, 0, 1, 1, hashlib.sha256(str(lone).encode()).hexdigest())


def test_lists_are_ranked_by_coins_alone(spark):
    order = list(range(200))
    random.Random(5).shuffle(order)
    rows = [(a, 0, 0, b, None if b is None else 0, None if b is None else 0, 1) for a, b in zip(order, [*order[1:], None])]
    items = spark.createDataFrame(rows, "c long, d long, x long, nc long, nd long, nx long, length long").repartition(3)
    level, levels = items, []
    for k in range(6):
        levels.append(common.staged(trie.by_coins(level, k), "coins"))
        level = levels[-1].filter("length is not null").select(*trie.ARC, *trie.NEXT, "length")
    assert level.count() < 120 and level.agg(F.sum("length")).first()[0] == 200
    got = {r["c"]: r["rank"] for r in trie.ranked(items, 20).collect()}
    assert [got[c] for c in order] == list(range(200))


@pytest.mark.parametrize("op", ["toxicity", "chat", "media", "packing", "topk", "jaccard", "language", "mixing"])
def test_empty_tables_and_clashing_columns(spark, op, tmp_path):
    texts = [None, "", "one two", "word " * 4000, "one two", "é ß"]
    clash = ("size", "node", "key", "text_", "score", "conv_id", "rank", "v", "count", "start")
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).withColumns({c: F.lit("clash") for c in clash})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vec = spark.createDataFrame([(50, [0.5, 1.0]), (1, [0.5])], "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in clash})
    talk = spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "user", "x"), (None, 1, None, None)], TURNS).withColumns({c: F.lit("clash") for c in ("messages", "formatted", "seq", "op", "n")})
    run = {
        "toxicity": lambda d, *_: toxicity.score(d, toxicity.fit(d, labels)), "media": lambda d, *_: media.op5_media(spark, d), "packing": lambda d, *_: packing.op6_packing(spark, d),
        "language": lambda d, *_: language.op10_language(spark, d), "mixing": lambda d, *_: mixing.op3_mixing(spark, d), "jaccard": lambda d, *_: jaccard.join(d),
        "topk": lambda _, v, __: topk.search(topk.blocks_of(topk.quantised(v)), topk.quantised(v)), "chat": lambda _, __, t: chat.read_back(chat.render(chat.fold(chat.turns_to_events(t)))),
    }[op]
    for name, tables in (("full", (docs, vec, talk)), ("empty", (docs.limit(0), vec.limit(0), talk.limit(0)))):
        where = str(tmp_path / name)
        for t, df in zip(("documents", "embeddings", "conversations"), tables):
            df.write.parquet(f"{where}/{t}.parquet")
        labels.write.parquet(f"{where}/labels.parquet")
        found = run(*([where] * 3 if op in ("media", "packing", "language", "mixing") else tables)).count()
        assert (found > 0) == (name == "full")


def test_pipeline_and_its_stages(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = {"en": "the of and to in is it as at by", "de": "der die und ein zu den von mit sich auf"}
    rows = []
    for i in range(240):
        lang = ["en", "de"][i % 2]
        text = " ".join(rng.choice(words[lang].split(), 80))
        rows.append((i, text + (" vile vile vile scum scum" if i % 5 == 0 else ""), lang, ["a", "b", None][i % 3], 1))
    rows += [(300, rows[1][1], "de", "a", 1), (301, rows[1][1] + " der", "de", "a", 1), (302, None, None, None, None), (1, rows[2][1] + " x", "en", "b", 1), (None, rows[4][1] + " y z", "en", "b", 1)]
    spark.createDataFrame(rows, DOCS).withColumn("taken", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns = common.table(spark, str(tmp_path), "documents"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        kept = common.staged(stage(spark, docs, str(tmp_path)), name)
        assert kept.columns == columns and 0 < kept.count() and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name == "toxicity":
            assert 150 < kept.count() < 220
        if name == "near_duplicates":
            assert kept.filter(F.col("text").contains(rows[1][1])).count() <= 1
        docs = kept
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert pieces and {r["doc_id"] for r in pieces} <= {r[0] for r in rows}


def test_the_operators_run_where_spark_names_no_shared_folder():
    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from codonloom.llm import common
path = common.shared_dir(spark)
assert path == common.shared_dir(spark) and common.staged(spark.range(3), "x").count() == 3 and spark.conf.get("spark.checkpoint.dir", None) is None
with common.scratch(spark):
    inside = common.fresh_path(spark, "y")
    spark.range(2).write.parquet(inside)
import os
assert not os.path.exists(inside.removeprefix("file://")) and os.path.exists(path.removeprefix("file://"))
print("FOLDER", path)
"""
    import os
    import tempfile

    env = os.environ | {"SPARK_CONF_DIR": tempfile.mkdtemp()}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert out.returncode == 0, out.stderr[-2000:]
    made = out.stdout.split("FOLDER ")[1].split()[0].removeprefix("file://")
    assert not os.path.exists(made)
