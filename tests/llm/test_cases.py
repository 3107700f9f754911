"""Odd input, brute force and bounds of the training-data operators."""

import collections
import hashlib
import random
import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from tests.llm.test_operators import docs, ids_of, prose
from tracewright.llm import binary_records, calibration, crf, embedding_dedup, exact_dedup, html_extract, minhash, mixing, packing, quality, secret_scan, toxicity
from tracewright.llm.queries import vocabulary

SMALL = "/root/testdata/sf0.001"


# op4


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: i % 3, lambda i: i])
def test_mixing_meets_targets_with_equal_ids(spark, ids):
    texts = ["ba de fi"] * 1200 + [f"ba de {i}" for i in range(800)] + ["la mi no po"] * 50
    sources = ["a"] * 2000 + ["b"] * 50
    table = docs(spark, texts, sources, [ids(i) for i in range(len(texts))])
    got = mixing.mix(table).toPandas()
    totals = {"a": 6000, "b": 200}
    assert len(got) == len(texts) and (got.taken <= 2 * got["size"]).all()
    for name, n in totals.items():
        part = got[got.source_size == n]
        assert abs(part.taken.sum() - mixing.targets(totals)[name]) <= 4
    rows = mixing.mixed_rows(table)
    assert rows.count() * 3 - got.taken.sum() <= 0 and rows.select((mixing.F.regexp_count("text", mixing.F.lit(mixing.WORD))).alias("n")).agg({"n": "sum"}).collect()[0][0] == got.taken.sum()


def test_mixing_targets_against_sql(spark):
    got = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet")).toPandas().sort_values("doc_id")
    sizes = duckdb.sql(rf"""
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY source)::BIGINT AS source_size
        FROM '{SMALL}/documents.parquet' ORDER BY doc_id""").df()
    assert got["size"].tolist() == sizes["size"].tolist() and got.source_size.tolist() == sizes.source_size.tolist()
    # the level at which the shares meet the budget, by halving: no source goes beyond twice its size
    names = sorted(sizes.source.dropna().unique()) + ([None] if sizes.source.isna().any() else [])
    total = {s: int(sizes.source_size[sizes.source.isna() if s is None else sizes.source == s].iloc[0]) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 2.0 * sum(total.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], 2 * total[s]) for s in names) < 1.5 * sum(total.values()) else (low, level)
    want = [min(low * weight[s], 2 * total[s]) for s in sizes.source.where(sizes.source.notna(), None)]
    assert np.allclose(got.target, want)


# op2, op3


def test_closing_keeps_most_of_the_placement():
    r = random.Random(5)
    documents = [(i, np.arange(min(4000, int(r.lognormvariate(6.3, 1))) + 1, dtype="<u4").tobytes()) for i in range(1250)]
    levels = packing.SumOfSquares()
    serial, held = iter(range(10**9)), {}
    for i, ids in documents:
        sequence, offset = levels.add(len(ids) // 4, lambda: next(serial))
        held.setdefault(sequence, []).append((i, ids, 0, len(ids) // 4, offset))
    open_ = [p for p in held.values() if p[-1][4] + len(p[-1][1]) // 4 < 4096]
    told: dict[str, int] = {}
    rows = list(packing.close(open_, lambda: next(serial), 4096, told))
    total = sum(len(ids) // 4 for _, ids in documents)
    assert told["cut"] < 0.05 * total and told["moved"] < 0.2 * total
    fill = collections.Counter()
    for row in rows:
        fill[row[5]] += row[2]
    assert sum(fill.values()) == sum(len(p[1]) // 4 for w in held.values() if w[-1][4] + len(w[-1][1]) // 4 < 4096 for p in w)
    assert all(n == 4096 or n & n - 1 == 0 for n in fill.values()) and sum(n != 4096 for n in fill.values()) <= 12


def test_tokens_of_odd_rows(spark):
    long_text = " ".join(["wörd", "again."] * 120_000)
    texts, ids = ["same text"] * 5 + [None, "x", "y", long_text], [3, 3, None, None, 3, 3, None, 9, 10]
    table = docs(spark, texts, ids=ids).withColumns({"start": mixing.F.lit(1), "sequence_id": mixing.F.lit("z"), "_hash": mixing.F.lit(0), "_row": mixing.F.lit(0)})
    got = packing.pack_documents(table, vocabulary("word_bpe_49k.json")).toPandas()
    assert got.length.sum() == sum(len(ids_of("word_bpe_49k.json", t, 2)) for t in texts)
    assert collections.Counter(got.doc_id.dropna()[got.start == 0]) == collections.Counter([3] * 4 + [9, 10])
    back = binary_records.round_trip(table, vocabulary("byte_bpe_50k.json")).toPandas().sort_values("start")
    assert back.doc_id.isna().tolist() == [True] * 3 + [False] * 6 and back.doc_id.dropna().tolist() == [3, 3, 3, 3, 9, 10]
    want = collections.Counter((-1 if i is None else i, zlib.crc32(ids_of("byte_bpe_50k.json", t, 0).tobytes())) for i, t in zip(ids, texts, strict=True))
    assert collections.Counter(zip(back.doc_id.fillna(-1).astype(int), back.ids_crc32, strict=True)) == want
    assert back.start.tolist() == [0, *np.cumsum(back.n_tokens).tolist()[:-1]]


def test_records_are_read_back_by_many_tasks(spark):
    path, manifest = binary_records.write_records(docs(spark, [prose(random.Random(i), 20) for i in range(400)]).repartition(6), vocabulary("byte_bpe_50k.json"))
    assert binary_records.read_records(path, manifest).rdd.getNumPartitions() == manifest.count()


# op5


def test_quality_fit_against_direct_sums(spark):
    r = random.Random(3)
    texts = [prose(r, r.randint(5, 80)) if i % 3 else "$$ !! " * r.randint(3, 30) for i in range(240)]
    labels = pd.DataFrame({"doc_id": range(240), "quality": [int(i % 3 > 0) if i % 7 else 1 - int(i % 3 > 0) for i in range(240)]})
    stats = quality.features(docs(spark, texts).repartition(5))
    model = quality.fit(stats, spark.createDataFrame(labels))
    rows = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = np.array([quality.statistics(texts[i]) for i in rows]), labels.quality.to_numpy()[rows].astype(float)
    mean, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-8))
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale, rtol=1e-4)
    z = np.clip((x - mean) / scale, -6, 6)
    phi = np.hstack([np.cos(z @ model.omega + model.phase) * np.sqrt(2 / quality.FEATURES), np.ones((len(z), 1))])
    side = quality.FEATURES + 1
    weights = np.linalg.solve(phi.T @ phi + quality.RIDGE * len(x) * np.eye(side) / quality.FEATURES, phi.T @ y)
    assert np.allclose(phi @ weights, model.raw(x), atol=1e-6)
    # the cosines approximate the Gaussian kernel
    a, b = np.random.default_rng(0).normal(size=(2, 200, 3))
    kernel = np.exp(-((a - b) ** 2).sum(1) / 3)
    mean = np.mean([(m.map(a)[:, :-1] * m.map(b)[:, :-1]).sum(1) for m in (quality.Model(np.zeros(3), np.ones(3), seed) for seed in range(40))], 0)
    assert np.abs(mean - kernel).mean() < 0.02
    got = quality.scored(docs(spark, texts), spark.createDataFrame(labels)).toPandas().sort_values("doc_id")
    assert np.allclose(got.score, model.score(np.array([quality.statistics(t) for t in texts])), atol=1e-9)


def test_isotonic_is_the_nearest_rising_function():
    r = np.random.default_rng(1)
    for _ in range(30):
        x, y, w = np.sort(r.normal(size=8)), r.random(8), r.integers(1, 5, 8).astype(float)
        at, p = calibration.isotonic(x, y, w, prior=0.0)
        mine = np.interp(x, at, p)
        # min-max formula of isotonic regression
        want = [max(min((w[a : b + 1] @ y[a : b + 1]) / w[a : b + 1].sum() for b in range(i, 8)) for a in range(i + 1)) for i in range(8)]
        means = [p[k] for k in range(len(p))]
        assert sorted(set(np.round(means, 9))) == sorted(set(np.round(want, 9))) and (np.diff(mine) >= -1e-12).all()


def test_accepted_keeps_what_scored_accepts(spark):
    table, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r.doc_id for r in quality.scored(table, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in quality.accepted(table, labels).collect()} == good


# op6


def test_candidates_are_few():
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    keep = [i for i, (v, x) in enumerate(zip(table["embedding"], table["label"], strict=True)) if v and x is not None]
    u, label = embedding_dedup.unit(np.array([table["embedding"][i] for i in keep], float)), np.array([table["label"][i] for i in keep])
    x = u @ embedding_dedup.rotation(u.shape[1])
    plan = embedding_dedup.Blocks(x.mean(0), x.var(0), 0.98, int(np.bincount(label).max()))
    tested, placed = 0, 0
    for rows, b, cell, home in plan.cells(x):
        placed += len(rows)
        for group in {*zip(label[rows].tolist(), cell.tolist(), strict=True)}:
            inside = (label[rows] == group[0]) & (cell == group[1])
            h, o, resident = rows[inside & home], rows[inside], home[inside]
            if len(h):
                for i, j in embedding_dedup.in_reach(x[h][:, plan.dims[b]], x[o][:, plan.dims[b]], plan.budget[b] + embedding_dedup.SLACK):
                    tested += int(np.where(resident[j], h[i][:, None] < o[j], True).sum())
    pairs = sum(n * (n - 1) // 2 for n in collections.Counter(label.tolist()).values())
    assert tested < 0.2 * pairs and placed < 8 * len(u)


def test_reach_loses_no_pair():
    r = np.random.default_rng(4)
    for _ in range(20):
        a, b = r.normal(size=(r.integers(1, 90), 5)), r.normal(size=(r.integers(1, 90), 5))
        a[::3] = a[0]
        near = {(i, j) for i, j in zip(*np.nonzero(((a[:, None] - b) ** 2).sum(2) <= 1.5), strict=True)}
        met = collections.Counter((i, j) for h, o in embedding_dedup.in_reach(a, b, 1.5) for i in h for j in o)
        assert near <= {*met} and set(met.values()) <= {1}


def test_vectors_of_odd_rows(spark):
    v = [1.0, 0.0, 0.0]
    rows = [(1, v, 1, 0), (1, [0.0, 1.0, 0.0], 1, 0), (2, [1.0, 0.01, 0.0], 1, 0), (None, v, 1, 0), (3, v[:2], 1, 0), (4, [2.0, 0.0], 1, 0), (5, [], 1, 0), (6, v, None, 0), (7, [-1.0, 0.0, 0.0], 1, 0), (8, [0.0, 1.0, 0.001], 1, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, block int").withColumn("cell", mixing.F.lit(1))
    got = sorted((-1 if x.vec_id is None else x.vec_id, x.n_links) for x in embedding_dedup.linked(table).collect())
    assert got == [(-1, 0), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (6, 0), (7, 0), (8, 1)]


# op7


def test_minhash_in_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 20)
    r = random.Random(16)
    passage, texts = prose(r, 60), []
    for _ in range(40):
        base = (passage + " " + prose(r, 30)).split()
        for _ in range(3):
            w = list(base)
            w[r.randrange(60, 90)] = "new"
            texts.append(" ".join(w))
    got = minhash.classes(docs(spark, texts)).toPandas().sort_values("doc_id")
    bags = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = [find(i) for i in range(len(texts))]
    assert sum(a != b for a, b in zip(got.class_id.tolist(), want, strict=True)) == 0


# op8


def own_spans(text):
    """The base patterns read by plain loops."""
    out, low, value = [], text.lower(), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if low[i : i + len(n)] == n and text[i : i + len(n)].isascii()), None)
        j = i + len(name) if name else i
        if name:
            j += text[j : j + 1] in ("'", '"') and bool(text[j : j + 1])
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] in (":", "=") and text[j : j + 1]:
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"') and bool(text[j : j + 1])
                k = j
                while k < len(text) and text[k] in value:
                    k += 1
                if k > j:
                    if k - j >= 6:
                        out.append(("assign", i, k))
                    i = k
                    continue
        i += 1
    for kind, begin, some, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            k = i + len(begin)
            if text.startswith(begin, i):
                while k < len(text) and text[k] in some:
                    k += 1
            if k > i + len(begin) and text.startswith(begin, i):
                if k - i >= least:
                    out.append((kind, i, k))
                i = k
            else:
                i += 1
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_spans_against_plain_loops(spark):
    r = random.Random(2)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "apikey", ":", "=", " ", "'", '"', "abc", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "é", "x", "/+=", "\n", "ſecret"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(600)] + [None, "", "token=" + "a" * 300_000]
    got = secret_scan.digest(secret_scan.scan(docs(spark, texts))).toPandas().sort_values("doc_id")
    for text, row in zip(texts, got.itertuples(), strict=True):
        want = own_spans(text or "")
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex")]
        assert [s for s in row.spans.split(",") if s and not s.startswith("crf")] == [f"{k}:{a}:{b}" for k, a, b in want]


def test_field_on_texts_it_has_not_seen(spark):
    r = random.Random(6)
    texts = [prose(r, r.randint(20, 60)) + "\n" + prose(r, 10).capitalize() for _ in range(900)]
    model = secret_scan.fit(docs(spark, texts[:700]))
    seen, unseen = secret_scan.measured(model, texts[700:]), secret_scan.measured(model, texts[700:], hidden=True)
    assert seen["secrets"] > 150 and seen["precision"] > 0.9 and seen["recall"] > 0.9, seen
    assert unseen["secrets"] > 150 and unseen["precision"] > 0.9 and unseen["recall"] > 0.8, unseen


def test_field_finds_the_span(spark):
    r = random.Random(6)
    texts = [prose(r, 40) for _ in range(500)]
    word = "9fKx2LmQ7vRtB4nZ8sYc1WpD6hGj3aEu"
    inside = [f"ghp_{word}", f'Authorization: Bearer "{word}"', "123e4567-e89b-12d3-a456-426614174000", "/usr/lib/python3/x86_64/site_12.py"]
    texts += [f"{prose(r, 25)} {x} {prose(r, 25)}" for x in inside]
    found = {x.doc_id: x.spans for x in secret_scan.scan(docs(spark, texts)).collect()}
    assert [[(s.kind, texts[i][s.start : s.end]) for s in found[i]] for i in range(500, 504)] == [[("crf", "ghp_" + word)], [("crf", word)], [], []]


def test_stretches_decode_as_the_whole():
    r = np.random.default_rng(1)
    for _ in range(200):
        k = int(r.integers(2, 5))
        model = crf.LinearChainCRF(k)
        model.moves, model.first = r.normal(size=(k, k)), r.normal(size=k)
        e = r.normal(size=(int(r.integers(1, 30)), k)) * 2
        e[:, 0] += r.uniform(0, 6)
        assert model.other_than_first(e) == {i: y for i, y in enumerate(model.decode(e)) if y}


def test_quick_weights_are_the_plain_ones():
    r = random.Random(4)
    texts = [prose(r, 30) for _ in range(60)]
    rows = [(w, y) for t in texts for w, y, _ in secret_scan.windows(t)]
    model = crf.LinearChainCRF(3).fit([secret_scan.describe(w, "digits=0") for w, _ in rows], [y for _, y in rows], epochs=5)
    tagger = secret_scan.Tagger(model)
    for w in ["plain", "Title", "word.", "(Word),", "what!", "über", "naïve", "x", "I", "token:", "=", "->", "a1", "ABC", "é", "日本", "-", "...", "key", "Key.", "abcdefghijklmnopqrstuvwxyzabcd"]:
        plain = [*tagger.sum(secret_scan._shape(w)), *tagger.sum(secret_scan._before(w)), *tagger.sum(secret_scan._after(w)), float(any(c in "0123456789" for c in w))]
        assert np.allclose(tagger.weigh(w), plain), w


# op9


def test_exact_dedup_spills_in_spark(spark, tmp_path):
    r = random.Random(5)
    texts = [prose(r, 40) for _ in range(600)] * 2
    small = exact_dedup.survivors(docs(spark, texts).drop("_sha256"), budget=20_000)
    assert sorted(x.doc_id for x in small.select("doc_id").collect()) == list(range(600))


# op10


class Reader(HTMLParser):
    """The article's blocks by its tags alone."""

    OUT = frozenset("nav header footer aside section form script style head noscript div ul".split())
    BREAK = frozenset("p h1 h2 h3 li blockquote td".split())

    def __init__(self):
        super().__init__()
        self.inside, self.out, self.parts = 0, [], [[]]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        elif self.inside and tag in self.OUT:
            self.out.append(tag)
        if tag in self.BREAK:
            self.parts.append([])
        if tag == "br" and self.inside and not self.out:
            self.parts[-1].append(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside -= 1
        elif self.out and tag == self.out[-1]:
            self.out.pop()
        if tag in self.BREAK:
            self.parts.append([])

    def handle_data(self, data):
        if self.inside and not self.out:
            self.parts[-1].append(data)


def test_pages_against_another_reader(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r.text for r in html_extract.extracted(table).collect()}
    wrong = 0
    for row in table.collect():
        reader = Reader()
        reader.feed(row.html or "")
        want = "\n".join(t for p in reader.parts if (t := " ".join("".join(p).split())))
        wrong += want != found[row.page_id]
    assert wrong <= 0.02 * len(found), wrong


INNER = "<article><h1>The headline</h1><p>First long paragraph of the article, with many words in it.</p>%s<p>And it ends here, with a few more words.</p></article>"
WANT = ["The headline", "First long paragraph of the article, with many words in it.", "And it ends here, with a few more words."]


@pytest.mark.parametrize(
    ("page", "more"),
    [
        ("<html><head><title>x</title><body>" + INNER % "", None),
        (INNER % "<button>Share", None),
        (INNER % "<button class=x><div>Share it</div></button>", None),
        (INNER % "<select><option>One<option>Two", None),
        (INNER.replace("<h1>", '<p title="a><h1>') % "", None),
        (INNER.replace("<h1>", '<h1 title="a > b">') % "", None),
        (INNER % '<p title="a>Second part of it.</p>', "Second part of it."),
        (INNER % "<p>If a < b and c > d then.</p>", "If a < b and c > d then."),
        (INNER % "<p>x &lt;b&gt; &amp;amp; y</p>", "x <b> &amp; y"),
    ],
)
def test_broken_pages(page, more):
    want = WANT[:2] + ([more] if more else []) + WANT[2:]
    assert html_extract.main_text(html_extract.trained(), page).split("\n") == want


@pytest.mark.parametrize("part", ['<a "', "<div><p>x", "<section>", '<p title="a>', "<p title='a>x\" ", "<button>x", "<!-- x ", "<script></script ", "<a = ", "&", "<svg>"])
def test_reading_takes_time_in_proportion(part):
    took = []
    for size in (200_000, 1_000_000):
        began = time.process_time()
        html_extract.main_text(html_extract.trained(), part * (size // len(part)))
        took.append(time.process_time() - began)
    assert took[1] < 15 and took[1] < 14 * max(took[0], 0.05), took


def test_pages_of_odd_rows(spark):
    page = "<article><p>Some words of an article, long enough to be one.</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "w", "<p>" + "many words, " * 200_000 + "</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": mixing.F.lit("x"), "n_chars": mixing.F.lit("y")})
    got = html_extract.extracted(table).collect()
    assert [r.text for r in got[:4]] == ["Some words of an article, long enough to be one."] * 3 + [""] and len(got) == 5
    assert all(r.n_chars == len(r.text) for r in got) and html_extract.extracted(table.limit(0)).count() == 0


# scores, all rows


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_scores_of_odd_rows(spark, module, label):
    r = random.Random(8)
    texts = [prose(r, 30) + (" idiot" if i % 2 else "") for i in range(60)] + [None, "", "word " * 300_000, "same", "same"]
    ids = [*range(60), None, 60, 61, 62, 62]
    table = docs(spark, texts, ids=ids).withColumns({"y": mixing.F.lit(1), "keys": mixing.F.lit(2), "stats": mixing.F.lit("s")})
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(60)] + [(None, 1, "x"), (5, None, "x"), (62, 1, "x")], f"doc_id long, {label} int, text string")
    got = module.scored(table, labels).toPandas()
    assert len(got) == len(texts) and got.score.between(0, 1).all() and got[got.doc_id == 62].score.nunique() == 1
    assert got.doc_id.isna().sum() == 1 and not got.isna().drop(columns="doc_id").any().any()


def test_pipeline_of_no_rows(spark):
    import corpus_pipeline

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SMALL)
        assert rows.count() == 0
