"""One table of odd rows through every operator and the pipeline, against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from credence.llm.blocks import import_on_workers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(8)


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


LONG = " ".join(f"w{i}" for i in RNG.integers(0, 40_000, 220_000))            # over one piece of 1 MB
PASSAGE = " ".join(f"p{i}" for i in range(80))
BASE = [f"b{i}" for i in RNG.integers(0, 500, 200)]
TEXTS = [
    (None, "a null id " + PASSAGE), (None, "a null id " + PASSAGE), (None, "another null id"), (None, None),
    (5, " ".join(BASE)), (5, "the same id, other words " + PASSAGE), (5, " ".join(BASE)), (5, " ".join(BASE)),
    (6, " ".join([*BASE[:100], "x", *BASE[101:]])), (7, ""), (8, " \t\n\x0b "), (9, None), (10, PASSAGE), (-3, "It's 12,5 <|endoftext|> naïve — 日本語 😀" * 3),
    (20, thue_morse(1024, "a", "b")), (21, thue_morse(1024, "b", "a")), (22, thue_morse(4096, "a", "b")), (23, thue_morse(4096, "b", "a")),
    (24, thue_morse(1024, "a ", "b ")), (25, thue_morse(1024, "b ", "a ")), (30, LONG), (31, LONG[: len(LONG) // 2] + " cut"),
]
#: Names that results and helpers of the operators use themselves.
CLASHES = ["kept", "n_words", "n_removed", "component_id", "score", "label", "digest", "part", "tail", "piece", "length", "__block", "__bucket", "__judged", "_row", "position"]


@pytest.fixture(autouse=True)
def _workers(spark):
    import_on_workers(spark)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en" if i % 2 else None, f"s{i}", len(t or ""), *["clash"] * len(CLASHES)) for i, (d, t) in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(4).cache()


def bag(rows):
    return Counter(tuple(r) for r in rows)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def removed(units, window):
    """For each row of TEXTS the mask of its removed units."""
    after_all = 1 << 62
    low = {}
    for (d, _), u in zip(TEXTS, units):
        for i in range(len(u) - window + 1):
            k = hash(tuple(u[i: i + window])) if isinstance(u, list) else u[i: i + window]
            low[k] = min(low.get(k, after_all), after_all if d is None else d)
    out = []
    for (d, _), u in zip(TEXTS, units):
        depth = np.zeros(len(u) + 1, int)
        for i in range(len(u) - window + 1):
            k = hash(tuple(u[i: i + window])) if isinstance(u, list) else u[i: i + window]
            if low[k] < (after_all if d is None else d):
                depth[i] += 1
                depth[i + window] -= 1
        out.append(np.cumsum(depth[:-1]) > 0)
    return out


def test_op1(odd):
    from credence.llm.quality import quality_rules
    want = []
    for d, t in TEXTS:
        t = t or ""
        w = WORD.findall(t)
        seen = Counter(zip(w, w[1:], w[2:]))
        again = {j for i in range(len(w) - 2) if seen[tuple(w[i: i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    found = quality_rules(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert bag(found) == Counter(want)


def test_op1_takes_references_of_other_texts(spark, odd):
    from credence.llm.quality import measures, quality_rules, references
    good = spark.createDataFrame([(i, " ".join(f"plain{j} word the of" for j in range(i, i + 40)), "en") for i in range(8)], "doc_id long, text string, lang string")
    refs = references(measures(good))
    own = {r.doc_id: r.class_distance for r in quality_rules(good).collect()}
    given = {r.doc_id: r.class_distance for r in quality_rules(good, refs=refs).collect()}
    assert own == given
    none = quality_rules(odd.where("lang is null"), refs=refs).collect()
    assert none and all(r.class_distance is None and r.kept == (not r.base_failed) for r in none)


def test_op2(odd):
    from credence.llm.seed_extend import remove_repeated_passages
    units = [WORD.findall(t or "") for _, t in TEXTS]
    want = [(d, len(u), int(g.sum()), sha(" ".join(w for w, x in zip(u, g) if not x).encode())) for (d, _), u, g in zip(TEXTS, units, removed(units, 50))]
    assert bag((r.doc_id, r.n_words, r.n_removed, sha(r.kept_text.encode())) for r in remove_repeated_passages(odd).collect()) == Counter(want)


def test_op5(odd):
    from credence.llm.bwt import remove_repeated_bytes
    units = [(t or "").encode() for _, t in TEXTS]
    want = []
    for (d, _), u, g in zip(TEXTS, units, removed(units, 50)):
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()) if len(g) else 0
        want.append((d, len(u), int(g.sum()), spans, sha(np.frombuffer(u, np.uint8)[~g].tobytes())))
    assert bag((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), sha(r.kept)) for r in remove_repeated_bytes(odd).collect()) == Counter(want)


def test_op3(odd):
    """Likeness by sketches equals the likeness of the paragraph sets themselves."""
    from credence.llm.iblt import _spans, fingerprint_versions, paragraphs
    order = sorted(((d, t or "") for d, t in TEXTS), key=lambda r: (r[0] is None, -(r[0] or 0), sha(r[1].encode())))

    def likeness(a, b):
        x, y = (Counter(paragraphs(*_spans([t.encode()]))[0].tolist()) for t in (a, b))
        return len(x & y) / len(x | y) if x | y else 1.0
    want = []
    for (d, t), (_, x) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 3] + x[: len(t) // 3]
        want.append((d, len(t), sha(edited.encode()), round(likeness(t, edited), 9), round(likeness(t, x), 9)))
    rows = fingerprint_versions(odd).collect()
    assert bag((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows) == Counter(want)
    copies = [r.fingerprint for r in rows if r.doc_id == 5 and r.n_chars == len(TEXTS[4][1])]
    assert len(copies) == 3 and len(set(copies)) == 1


def test_op6(odd):
    import base64

    import public_tokenizers as P
    import tiktoken

    from credence.llm.bpe import encode_documents
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))})
    want = []
    for d, t in TEXTS:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert bag(encode_documents(odd, path, P.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256")).collect()) == Counter(want)


def shingles(t, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_op8(odd):
    from credence.llm.setsketch import near_duplicates
    sets = [shingles(t, 3) for _, t in TEXTS]
    links = {}

    def root(x):
        while links.setdefault(x, x) != x:
            x = links[x]
        return x
    for i, (a, _) in enumerate(TEXTS):
        for j, (b, _) in enumerate(TEXTS[:i]):
            if a is not None and b is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                links[y] = x
    found = near_duplicates(odd).collect()
    same_id = {5: {len(sets[i]) for i, (d, _) in enumerate(TEXTS) if d == 5}}
    assert len(found) == len(TEXTS)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == root(r.doc_id) and r.kept == (r.doc_id == r.component_id)
        assert r.doc_id != 5 or r.n_shingles in same_id[5]


def test_op10(odd):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from credence.llm.packing import pack, token_pieces
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for d, t in TEXTS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((d, i // 2048, i, len(ids[i: i + 2048]), zlib.crc32(ids[i: i + 2048].tobytes())) for i in range(0, len(ids), 2048))
    rows = pack(token_pieces(odd, path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == np.concatenate([[0], np.cumsum([n for _, n in sorted(p)])])[:-1].tolist() and sum(n for _, n in p) <= 2048


def test_op7(odd):
    from credence.llm import lm
    rows = lm.score_documents(odd).collect()
    assert sorted(r.doc_id is None for r in rows) == sorted(d is None for d, _ in TEXTS)
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in TEXTS)


def test_op12(spark, odd):
    from credence.llm.toxicity import fit_toxicity, score_toxicity
    labels = spark.createDataFrame([(5, 1, 1), (6, 0, 0), (10, 0, None), (None, 1, 1), (20, 1, 0), (20, 0, 1)], "doc_id long, quality int, toxic int")
    model = fit_toxicity(odd, labels)
    rows = score_toxicity(odd, model).collect()
    assert Counter((r.doc_id, r.held_out) for r in rows) == Counter((d, d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, _ in TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    blank = {r.score for r in rows if r.doc_id in (7, 8, 9)}
    assert len(blank) == 1
    none = score_toxicity(odd, fit_toxicity(odd, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert score_toxicity(odd.limit(0), model).collect() == []


def test_op12_learns_and_holds_out(spark):
    """Held-out accuracy; labels of the held-out third change no score."""
    from pyspark.sql import functions as F

    from credence.llm.toxicity import held_out, toxicity
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity(docs, labels).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    rank, pos = held.score.rank(), held.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.94 and (held[held.predicted == 1].toxic == 1).mean() > 0.95 and (held[pos].predicted == 1).mean() > 0.5
    small = docs.where("doc_id < 600")
    a = toxicity(small, labels).toPandas().set_index("doc_id").score
    b = toxicity(small, labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))).toPandas().set_index("doc_id").score
    assert (a == b).all()


def test_ftrl_gives_sparse_weights_of_the_right_sign():
    from credence.llm.toxicity import ftrl_pass, weights
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 2, 400)
    rows = [np.concatenate([[0], [1] if y else [2], 3 + rng.choice(200, 5, replace=False)]) for y in labels]
    z, n = np.zeros(203), np.zeros(203)
    for _ in range(3):
        ftrl_pass(rows, labels.astype(float), z, n)
    w = weights(z, n)
    assert w[1] > 1 and w[2] < -1 and (w[3:] == 0).mean() > 0.8


@pytest.mark.parametrize("seed", range(4))
def test_packing_needs_no_more_than_best_fit_decreasing(seed):
    from bisect import bisect_left, insort

    from credence.llm.packing import Plan
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 2049, 3000), np.clip(np.exp(rng.normal(6, 1, 6000)).astype(int) + 1, 1, 2048), np.repeat([700, 650], 1500),
               np.concatenate([rng.integers(900, 1100, 2000), rng.integers(30, 90, 3000), rng.integers(400, 600, 1500)])][seed]
    gaps, bins = [], 0
    for n in sorted(lengths.tolist(), reverse=True):
        i = bisect_left(gaps, n)
        if i < len(gaps):
            insort(gaps, gaps.pop(i) - n)
        else:
            bins += 1
            insort(gaps, 2048 - n)
    assert Plan(Counter(lengths.tolist()), 2048).sequences <= bins


def test_pages_with_null_ids_and_clashing_columns(spark):
    from credence.llm.urls import RULES, judge_urls, rule_table
    from credence.llm.warc import derive, page_responses
    rows = [(None, "http://a.example.com/de/x", "<p>1</p>", "k", "v", "h"), (None, None, None, "k", "v", "h"), (1, "http://sub.example.net/en/", "<p>2</p>", "k", "v", "h"), (1, "http://sub.example.net/en/", "<p>2</p>", "k", "v", "h"), (2, "", "", "k", "v", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string, verdict string, host string")
    judged = judge_urls(pages, rule_table(spark, RULES)).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in judged) == Counter([(None, "a.example.com", "/de/x", "example.com/de/"), (None, "", "", None), *[(1, "sub.example.net", "/en/", "example.net/en/")] * 2, (2, "", "", None)])
    records = derive(page_responses(pages)).collect()
    assert Counter((r.page_id, r.kind) for r in records) == Counter({(p, k): n for p, n in ((None, 2), (1, 2), (2, 1)) for k in ("metadata", "conversion")})


def test_pipeline_stages_on_odd_rows(spark, odd):
    """Every stage takes nulls, repeats and clashing columns; a stage drops only what it rejects."""
    import corpus_pipeline
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = bag(docs.select(*corpus_pipeline.COLUMNS).collect())
        docs = stage(spark, docs, "/nowhere").cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        if name != "substring_dedup":
            assert not bag(docs.collect()) - before
        if name == "quality_rules":
            left = docs.collect()
            assert not any(not WORD.search(r.text or "") for r in left)                 # null ids and null texts go as well
            assert sum(r.doc_id is None for r in left) == 2 and {r.doc_id for r in left} >= {30, 31, 10}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/nowhere").count() > 0
