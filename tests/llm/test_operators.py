import collections
import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracewright.llm import binary_records, crf, embedding_dedup, exact_dedup, html_extract, minhash, mixing, packing, quality, secret_scan, toxicity
from tracewright.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _sha256 string, score double, part int"


def docs(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], None if t is None else len(t), "x", 1.0, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(r, n):
    return " ".join("".join(r.choice(["ba", "de", "fi", "go", "lu", "mi"]) for _ in range(r.randint(1, 4))) for _ in range(n))


ODD = [None, "", " ", "a", "a", "  a\t b", "Zwei\n\nWörter", "x" * 3000, "it's <|endoftext|> 12 don't!?", " nb sp\x1cx", "é" * 10]


@pytest.fixture(scope="module")
def some():
    r = random.Random(1)
    return ODD + [prose(r, r.randint(1, 900)) + ("\n" + prose(r, 30) if r.random() < 0.5 else "") for _ in range(60)] + [prose(r, 9000)]


def ids_of(name, text, end):
    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(spark, some):
    got = packing.pack_documents(docs(spark, some), vocabulary("word_bpe_49k.json")).toPandas()
    for i, text in enumerate(some):
        want, mine = ids_of("word_bpe_49k.json", text, 2), got[got.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(want) == mine.doc_tokens.iloc[0] and mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]]
        assert all(zlib.crc32(want[s : s + n].tobytes()) == c for s, n, c in zip(mine.start, mine.length, mine.ids_crc32, strict=True))
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        size = seq.length.sum()
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and (size == 4096 or size & size - 1 == 0) and size <= 4096
    assert packing.pack_documents(docs(spark, some).limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_sum_of_squares_is_least():
    r, levels, open_ = random.Random(2), packing.SumOfSquares(20), collections.Counter()
    serial = iter(range(10**6))
    for _ in range(400):
        size = r.randint(1, 19)

        def cost(h, size=size):
            c = open_.copy()
            if h:
                c[h] -= 1
            if h + size < 20:
                c[h + size] += 1
            return sum(v * v for v in c.values())

        _, h = levels.add(size, lambda: next(serial))
        assert cost(h) == min(cost(x) for x in range(21 - size) if x == 0 or open_[x])
        if h:
            open_[h] -= 1
        if h + size < 20:
            open_[h + size] += 1


def test_records(spark, some):
    got = binary_records.round_trip(docs(spark, some), vocabulary("byte_bpe_50k.json")).toPandas().sort_values("doc_id")
    want = [ids_of("byte_bpe_50k.json", t, 0) for t in some]
    assert got.n_tokens.tolist() == [len(w) for w in want] and got.start.tolist() == [0, *np.cumsum([len(w) for w in want]).tolist()[:-1]]
    assert got.ids_crc32.tolist() == [zlib.crc32(w.tobytes()) for w in want]
    assert binary_records.round_trip(docs(spark, some).limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_record_damage():
    record = binary_records.frame(-5, np.array([1, 70000], "<u4").tobytes())
    doc_id, ids, end = binary_records.unframe(b"zz" + record, 2)
    assert (doc_id, ids.tolist(), end) == (-5, [1, 70000], len(record) + 2)
    assert binary_records.unframe(binary_records.frame(None, b""))[0] is None
    for k in range(len(record)):
        with pytest.raises(ValueError, match="record"):
            binary_records.unframe(record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :])
        with pytest.raises(ValueError, match="cut off"):
            binary_records.unframe(record[:k])


def test_mixing(spark):
    r = random.Random(3)
    texts = [None, "", " "] + [prose(r, r.randint(1, 60)) for _ in range(400)] + ["ba de fi"] * 300
    sources = [None if i % 7 == 0 else r.choice(["a", "b", "ü", "zz"]) for i in range(len(texts))]
    got = mixing.mix(docs(spark, texts, sources)).toPandas().sort_values("doc_id")
    size = [len((t or "").split()) for t in texts]
    assert got["size"].tolist() == size and (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(1) == 0).all()
    totals = collections.Counter()
    for s, n in zip(sources, size, strict=True):
        totals[s] += n
    goals = mixing.targets(totals)
    assert abs(sum(goals.values()) - 1.5 * sum(size)) < 1e-6 and all(goals[s] <= 2 * totals[s] + 1e-9 for s in totals)
    got["source"] = [s or "" for s in sources]
    for s, part in got.groupby("source"):
        assert abs(part.taken.sum() - goals[s or None]) <= 1 and (part.target == goals[s or None]).all()
    again = mixing.mix(docs(spark, texts, sources).repartition(7)).toPandas().sort_values("doc_id")
    assert again.taken.tolist() == got.taken.tolist()
    rows = mixing.mixed_rows(docs(spark, texts, sources))
    assert rows.columns == docs(spark, texts).columns
    times = collections.Counter(x.doc_id for x in rows.select("doc_id").collect())
    assert all(times[i] * n == k for i, n, k in zip(got.doc_id, got["size"], got.taken, strict=True) if n)
    assert mixing.mix(docs(spark, texts, sources).limit(0)).count() == 0


def test_subset_sum():
    r = random.Random(4)
    for _ in range(100):
        lengths = sorted(r.sample(range(1, 30), 5))
        counts = [r.randint(0, 4) for _ in lengths]
        budget = r.randint(0, 150)
        sums = {0}
        for length, n in zip(lengths, counts, strict=True):
            sums = {s + k * length for s in sums for k in range(n + 1)}
        got = mixing.subset_sum(budget, lengths, counts)
        assert sum(k * v for k, v in got.items()) == max(s for s in sums if s <= budget) and all(got.get(x, 0) <= n for x, n in zip(lengths, counts, strict=True))


def test_exact_dedup(spark, some):
    texts = some + ["a b", "a\nb ", " ab", None] * 30
    got = exact_dedup.groups(docs(spark, texts)).toPandas().sort_values("doc_id")
    key = ["".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r") for t in texts]
    groups = collections.defaultdict(list)
    for i, k in enumerate(key):
        groups[k].append(i)
    keep = {k: min(v, key=lambda i: (-len(texts[i] or ""), i)) for k, v in groups.items()}
    assert got.keep_id.tolist() == [keep[k] for k in key] and got.group_size.tolist() == [len(groups[k]) for k in key]
    rows = exact_dedup.deduplicate(docs(spark, texts))
    assert rows.columns == docs(spark, texts).columns and sorted(r.doc_id for r in rows.collect()) == sorted(keep.values())
    assert exact_dedup.groups(docs(spark, texts).limit(0)).count() == 0
    assert exact_dedup.groups(docs(spark, ["x", "x"], ids=[None, 4])).where("keep_id = 4 and group_size = 2").count() == 2


def test_grace_spills():
    r = random.Random(5)
    contents = [bytes([r.randrange(256)]) * r.randint(1, 50) for _ in range(4000)]
    entries = ([zlib.crc32(c) * 0x100000001 & 2**64 - 1, c, 1, (i,), (i,), b""] for i, c in enumerate(contents))
    got = {e[1]: (e[2], e[3][0]) for e in exact_dedup.grace(entries, budget=20_000)}
    assert got == {c: (n, contents.index(c)) for c, n in collections.Counter(contents).items()}


def test_minhash(spark):
    r = random.Random(6)
    texts = [None, "", "one", "One ", "two words"]
    for _ in range(25):
        base = prose(r, r.randint(30, 200)).split()
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = "new" + str(r.random())
            texts.append(" ".join(w))
    got = minhash.classes(docs(spark, texts)).toPandas().sort_values("doc_id")
    bags = [collections.Counter(tuple((t or "").lower().split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))) if (t or "").split() else None for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            if a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert got.class_id.tolist() == [find(i) for i in range(len(texts))]
    rows = minhash.distinct_rows(docs(spark, texts))
    assert rows.columns == docs(spark, texts).columns and sorted(x.doc_id for x in rows.collect()) == sorted({find(i) for i in range(len(texts))})
    assert minhash.classes(docs(spark, texts).limit(0)).count() == 0


def test_bagminhash_is_unbiased():
    r = np.random.default_rng(7)
    keys = minhash.mixed(np.arange(60, dtype=np.uint64))
    a, b = r.integers(0, 9, 60), r.integers(0, 9, 60)
    bag = lambda c: (keys[c > 0], c[c > 0])
    one, two = minhash.signatures([bag(a), bag(b)], 20_000)
    assert abs((one == two).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def test_embeddings(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(40, 16))
    vectors = [(b * s + r.normal(size=16) * e).tolist() for b in base for s, e in ((1, 0), (2, 0), (1, 0.1), (1, 0.15), (1, 0.4))]
    bad = [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] * 16]
    rows = [(i, v, None if i % 11 == 0 else i % 2, "x") for i, v in enumerate(vectors + bad + vectors[:3])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    got = embedding_dedup.linked(table).toPandas().sort_values("vec_id")
    ok = [v is not None and None not in v and np.isfinite(v).all() and any(v) and rows[i][2] is not None for i, v in enumerate(x[1] for x in rows)]
    m = np.array([np.float32(v).astype(float) if ok[i] else np.zeros(16) for i, v in enumerate(x[1] for x in rows)])
    u = m / np.maximum(np.sqrt((m * m).sum(1)), 1e-300)[:, None]
    labels = np.array([-1 if x[2] is None else x[2] for x in rows])
    near = (u @ u.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    assert got.n_links.tolist() == near.sum(1).tolist()
    comp = np.arange(len(rows))
    for _ in rows:
        comp = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(rows))])
    assert got.component_id.tolist() == comp.tolist() and (got.kept == (got.vec_id == got.component_id)).all()
    assert embedding_dedup.linked(table.limit(0)).count() == 0


def test_crf_learns_and_decodes():
    r = random.Random(9)
    rows = [[r.randrange(2) for _ in range(r.randint(1, 6))] for _ in range(80)]
    model = crf.LinearChainCRF(2).fit([[[f"x={y}", "b"] for y in row] for row in rows], rows)
    assert [model.decode(model.emissions([[f"x={y}"] for y in row])) for row in rows] == rows
    e = np.array([[r.gauss(0, 1) for _ in range(2)] for _ in range(6)])
    best = max(np.ndindex(*[2] * 6), key=lambda p: model.first[p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:])))  # noqa: B905
    assert model.decode(e) == list(best)


def test_secrets(spark):
    hexa = "0123456789abcdef" * 2
    texts = [None, "", f"é token = \"{hexa}\" end", "Password:short1", "secret=abc", "AKIA" + "A1" * 8, "AKIA1", f"x{hexa}y", "api_key='abcdefgh'"]
    got = secret_scan.digest(secret_scan.scan(docs(spark, texts))).toPandas().sort_values("doc_id")
    assert got[["n_assign", "n_access", "n_hex"]].to_numpy().tolist() == [[0, 0, 0], [0, 0, 0], [1, 0, 1], [1, 0, 0], [0, 0, 0], [0, 1, 0], [0, 0, 0], [0, 0, 1], [1, 0, 0]]
    assert got.spans.iloc[2] == f"assign:2:{11 + 32},hex:11:{11 + 32}" and got.spans.iloc[0] == ""
    assert secret_scan.digest(secret_scan.scan(docs(spark, texts).limit(0))).count() == 0


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy now.</div><article><h1>The  head&amp;line</h1><p><b>First &lt;one&gt;<br>go<p>Second
    one.</article><form><input><p>Mail</p></form><section class="comments"><p>I like it a lot.</p></section><footer>&copy; me</footer></body></html>"""
    pages = spark.createDataFrame([(0, "u", page, "t"), (1, None, None, "t"), (2, "u", "", "t"), (3, "u", "<p", "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extracted(pages).collect()}
    assert got[0].text == "The head&line\nFirst <one> go\nSecond one." and got[0].n_chars == len(got[0].text)
    assert got[1].text == got[2].text == "" and len(got) == 4
    assert html_extract.extracted(pages.limit(0)).count() == 0


def test_html_field_generalises():
    model, wrong, total = html_extract.fit(), 0, 0
    for page in html_extract.labelled_pages(100, seed=99):
        labels = model.decode(model.emissions([html_extract.describe(b) for b, _ in page]))
        wrong += sum(a != y for a, (_, y) in zip(labels, page, strict=True))
        total += len(page)
    assert wrong / total < 0.05


def test_block_max_index_is_exact():
    r = random.Random(11)
    vectors = [{t: r.randint(1, 4) for t in r.sample(range(30), r.randint(0, 6))} for _ in range(500)]
    idf = np.array([r.random() + 0.5 for _ in range(30)])
    index = toxicity.BlockMaxIndex(idf, vectors, np.array([r.randrange(2) for _ in vectors]))
    for _ in range(40):
        q = {t: r.randint(1, 4) for t in r.sample(range(30), r.randint(1, 6))}
        at, cos = index.nearest(list(q), list(q.values()), 9)
        t, w = index.weigh(list(q), list(q.values()))
        full = w @ index.weights[t]
        want = np.lexsort((np.arange(len(full)), -full))[:9]
        assert np.allclose(cos, full[want][full[want] > 0])


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_scores(spark, module, label):
    r = random.Random(12)
    texts = [None, "", "x" * 5000] + [prose(r, 60) + (" idiot scum" if i % 2 else "") if label == "toxic" else prose(r, 60) if i % 2 else "!!! $$$ " * 40 for i in range(300)]
    labels = spark.createDataFrame([(i, None if i < 1 else (i - 3) % 2) for i in range(len(texts))] + [(9999, 1)], f"doc_id long, {label} int")
    got = module.scored(docs(spark, texts), labels).toPandas().sort_values("doc_id")
    modulus, out = (5, 0) if label == "toxic" else (4, 2)
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % modulus == out for i in range(len(texts))]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= (0.5 if label == "toxic" else 0.7))).all()
    held = got[got.held_out & (got.doc_id >= 3)]
    assert (held.predicted == (held.doc_id - 3) % 2).mean() > 0.95
    empty = module.scored(docs(spark, texts).limit(0), labels)
    assert empty.count() == 0
    assert module.scored(docs(spark, texts), labels.limit(0)).count() == len(texts)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [before.count()]
    rows = before
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, rows, sf).write.parquet(f"{tmp_path}/{len(counts)}")
        rows = spark.read.parquet(f"{tmp_path}/{len(counts)}")
        assert rows.columns == before.columns
        counts.append(rows.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    kept = spark.read.parquet(f"{tmp_path}/2")
    assert exact_dedup.groups(kept).where("not kept").isEmpty()
    assert minhash.classes(spark.read.parquet(f"{tmp_path}/3")).where("not kept").isEmpty()
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, sf).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in rows.select("doc_id").collect()}
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


@pytest.mark.parametrize("part", [20, 1500])
def test_embeddings_in_crowded_cells(spark, monkeypatch, part):
    monkeypatch.setattr(embedding_dedup, "PART", part)
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 24))
    m = (centres[r.integers(0, 6, 400)] + r.normal(size=(400, 24)) * r.choice([0.02, 0.1, 0.15], 400)[:, None]).astype(np.float32)
    m[9] = m[5] = m[4]
    u = m.astype(float) / np.sqrt((m.astype(float) ** 2).sum(1, keepdims=True))
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(m)], "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.linked(rows).toPandas().sort_values("vec_id")
    assert near.sum() > 10_000 and got.n_links.tolist() == near.sum(1).tolist()
    comp = np.arange(400)
    for _ in range(20):
        comp = np.array([min([comp[i], *comp[near[i]]]) for i in range(400)])
    assert got.component_id.tolist() == comp.tolist()


def test_toxicity_sample_is_bounded(spark):
    rows = [(1, "plain words here", 0), (2, "vile idiot scum", 1)]
    found = spark.createDataFrame([(i, t) for i, t, _ in rows] * 40, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.scored(found, labels, modulus=1, held_out=5, examples=10).toPandas()
    assert len(got) == 80 and (got.groupby("doc_id").score.nunique() == 1).all() and got.score.between(0, 1).all()


@pytest.mark.parametrize(("name", "blank"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_cached_ids_are_exact(monkeypatch, name, blank):
    from tokenizers import Tokenizer

    from tracewright.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 500)
    r = random.Random(3)
    parts = [*"ab, .0\n\t\x1c 　é!'<|>", "<|endoftext|>", "  ", "\n\n", "don't", "THE"]
    found = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(4000)] + ["x" * 500 + " " + "y," * 200, "a \x1cb", "a\tb  c", "a \tb", " ", "plain words, and\nlines"]
    plain, cached = Tokenizer.from_file(vocabulary(name)), tokens.Encoder(vocabulary(name), blank)
    plain.encode_special_tokens = True
    for at in range(0, len(found), 512):
        part = found[at : at + 512]
        assert cached.encode(part) == [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch(part, add_special_tokens=False)]


def test_toxicity_weighs_all_terms(spark):
    """Score's evidence against brute force over every term: texts without any telling term too."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    common = [word() for _ in range(30)]
    texts = [" ".join([*r.sample(common, 9), *(word() for _ in range(r.randint(1, 25)))] + (["idiot"] if i % 9 == 0 else [])) for i in range(260)] + ["", None, "QQQQ 9999"]
    texts += texts[:3] + [texts[5] + " zzzz1 zzzz1 zzzz2"] * 2
    truth = {i: int(i % 9 == 0) for i in range(200)}
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    rows = toxicity.scored(docs(spark, texts), labels, modulus=1, held_out=5).toPandas().sort_values("doc_id")
    bags = [collections.Counter(f for w in (t or "").split() for f in toxicity.forms(w)) for t in texts]
    df = collections.Counter(t for b in bags for t in b)
    n, n1 = len(truth), sum(truth.values())

    def weight(t):
        a, b = sum(t in bags[i] for i in truth), sum(t in bags[i] for i in truth if truth[i])
        chi = n * (b * n - a * n1) ** 2 / (a * (n - a) * n1 * (n - n1)) if 0 < a < n else 0
        return (np.log((len(texts) + 1) / (df[t] + 1)) + 1) * np.sqrt(1 + chi)

    weights = {t: weight(t) for t in df}
    vectors = [{t: (1 + np.log(c)) * weights[t] for t, c in b.items()} for b in bags]
    norms = [np.sqrt(sum(x * x for x in v.values())) or 1 for v in vectors]
    for i, v in enumerate(vectors):
        cos = sorted((sum(x * vectors[j].get(t, 0) for t, x in v.items()) / norms[i] / norms[j] for j in truth), reverse=True)[:3]
        got = [float(e.split(":")[1]) for e in rows.evidence.iloc[i].split(", ") if e]
        assert np.allclose(got, [c for c in cos if c > 0], atol=2e-4), i
    assert (rows.evidence != "").sum() == len(texts) - 3


def test_secret_field_finds_other_forms(spark):
    """Letters only and unnamed, which no base pattern reads."""
    r = random.Random(31)
    secret = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    texts = [prose(r, 40).replace(" ", f' api_key = "{secret(32)}" ', 1) if i % 3 == 0 else prose(r, 30) + f" {r.randrange(10**5)} " + prose(r, 9).capitalize() for i in range(400)]
    letters = "qXvTzRkWpLsHgBnMdFjCyKwZtVxQrPbN"
    texts += [f"ba de token -> {letters} fi go", f"ba de go {letters} lu, mi.", prose(r, 60)]
    found = {x.doc_id: x.spans for x in secret_scan.scan(docs(spark, texts)).collect()}
    for i in (400, 401):
        assert secret_scan.base_spans(texts[i]) == []
        assert [texts[i][s.start : s.end] for s in found[i]] == [letters]
    assert found[402] == [] and sum(s.kind == "crf" for i in range(400) for s in found[i]) == 0


def test_html_open_heads_and_forms():
    model = html_extract.fit()
    inner = "<article><h1>The headline</h1><p>First long paragraph of the article, with many words in it.</p><p>And it ends here.</p></article>"
    want = "The headline\nFirst long paragraph of the article, with many words in it.\nAnd it ends here."
    pages = [f"<html><head><title>T</title><body>{inner}</body></html>", f"<html><head><title>T</title><style>p {{}}</style>{inner}</html>", f"<body><form action=x><input type=hidden>{inner}<select><option>One</select></form></body>", f"<body><form><input>{inner}</body>"]
    assert [html_extract.main_text(model, page) for page in pages] == [want] * 4
    assert html_extract.main_text(model, inner.replace("many words", "<math><mi>x</mi><mo>=</mo><mn>2</mn></math>")) == want.replace("many words", "x=2")


def test_mixing_fits_long_documents():
    rounds, extra = mixing.fit(139_000.0, [69_000, 70_000, 100_000], [1, 1, 1])
    assert (rounds, extra) == (0, {69_000: 1, 70_000: 1})
    r = random.Random(41)
    for _ in range(20):
        lengths = sorted(r.sample(range(66_000, 300_000), 5))
        target = r.randint(66_000, sum(lengths) - 1)
        best = max(s for m in range(32) if (s := sum(x for i, x in enumerate(lengths) if m >> i & 1)) <= target)
        assert sum(x * k for x, k in mixing.fit(float(target), lengths, [1] * 5)[1].items()) == best
