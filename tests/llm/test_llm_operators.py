"""Edge rows and brute-force versions for the training-data operators."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from credence.llm.blocks import import_on_workers

SF001 = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(3)
VOCAB = [f"w{i}" for i in range(60)] + ["naïve", "straße", "The", "the,"]


def words(n):
    return [VOCAB[i] for i in RNG.integers(0, len(VOCAB), n)]


PASSAGE = " ".join(f"shared{i}" for i in range(70))
BASE = words(120)
NEAR = [*BASE[:60], "changed", *BASE[61:]]
TEXTS = [None, "", "   \n\t ", "one", "two words", " ".join(BASE), " ".join(BASE), " ".join(NEAR), " ".join(words(80)) + "\n" + PASSAGE, PASSAGE + " " + " ".join(words(40)),
         " ".join(words(3000)), "a " * 400, "THE!! " * 80, "x" * 300, "y" + "x" * 300, "𝕏é日本 " * 30 + "it's I'LL 12,5  end   x", "\n".join(["same line here"] * 30), "a  b\n\n c　 d \r\n"]
ROWS = [(i * 7 % 101, t, "en" if i % 3 else None, f"s{i}", 1) for i, t in enumerate(TEXTS)]


@pytest.fixture(autouse=True)
def _workers(spark):
    import_on_workers(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_words long").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


TEXT = {r[0]: r[1] or "" for r in ROWS}


def removed_brute(units, ids, window):
    low = {}
    for d in ids:
        for i in range(len(units[d]) - window + 1):
            w = tuple(units[d][i: i + window])
            low[w] = min(low.get(w, d), d)
    out = {}
    for d in ids:
        gone = np.zeros(len(units[d]), bool)
        for i in range(len(units[d]) - window + 1):
            if low[tuple(units[d][i: i + window])] < d:
                gone[i: i + window] = True
        out[d] = gone
    return out


def test_seed_extend_brute_force(docs, empty):
    from credence.llm.seed_extend import remove_repeated_passages
    units = {d: WORD.findall(t) for d, t in TEXT.items()}
    gone = removed_brute(units, list(TEXT), 50)
    rows = remove_repeated_passages(docs).collect()
    assert len(rows) == len(ROWS) and any(r.n_removed for r in rows)
    for r in rows:
        assert (r.n_words, r.n_removed) == (len(units[r.doc_id]), gone[r.doc_id].sum())
        assert r.kept_text == " ".join(w for w, g in zip(units[r.doc_id], gone[r.doc_id]) if not g)
    assert remove_repeated_passages(empty).collect() == []


def test_bwt_brute_force(docs, empty):
    from credence.llm.bwt import remove_repeated_bytes
    units = {d: t.encode() for d, t in TEXT.items()}
    gone = removed_brute(units, list(TEXT), 50)
    for r in remove_repeated_bytes(docs).collect():
        want = bytes(b for b, g in zip(units[r.doc_id], gone[r.doc_id]) if not g)
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(units[r.doc_id]), gone[r.doc_id].sum(), want)
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert remove_repeated_bytes(empty).collect() == []


@pytest.mark.parametrize("unit", ["word", "byte"])
def test_one_passage_in_many_surroundings(spark, monkeypatch, unit):
    """Windows at the border of a shared passage, in more segments than one bucket may match together."""
    from credence.llm import repeats, seed_extend
    from credence.llm.bwt import remove_repeated_bytes
    monkeypatch.setattr(repeats, "HOT", 20)
    matched = seed_extend.match_by_extension

    def counted(window, gram):
        inner = matched(window, gram)

        def match(body, offsets, low):
            of, least = inner(body, offsets, low)
            if len(low) > 60 and len(of) > len(low):
                raise AssertionError(f"{len(low)} segments of several windows in one bucket")
            return of, least
        return match
    monkeypatch.setattr(seed_extend, "match_by_extension", counted)
    texts = {i: f"own{i} a{i % 3} b{i % 2} " + PASSAGE + f" c{i % 2} after{i}" for i in range(100)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    units = {d: WORD.findall(t) if unit == "word" else t.encode() for d, t in texts.items()}
    gone = removed_brute(units, list(texts), 50)
    rows = (seed_extend.remove_repeated_passages if unit == "word" else remove_repeated_bytes)(df).collect()
    assert len(rows) == 100 and {r.doc_id: r.n_removed for r in rows} == {d: g.sum() for d, g in gone.items()}
    for r in rows:
        kept = [x for x, g in zip(units[r.doc_id], gone[r.doc_id]) if not g]
        assert (r.kept_text == " ".join(kept)) if unit == "word" else (bytes(r.kept) == bytes(kept))


@pytest.mark.parametrize("unit", ["word", "byte"])
def test_few_long_segments_of_one_key(spark, monkeypatch, unit):
    """Texts that repeat one word pair: few segments, each with many windows of one key."""
    from credence.llm import bwt, repeats, seed_extend
    monkeypatch.setattr(repeats, "HOT", 20)

    def bounded(make):
        def with_limits(*sizes, **more):
            inner = make(*sizes, **more)

            def match(body, offsets, low):
                of, least = inner(body, offsets, low)
                if len(of) > 20 * 40:
                    raise AssertionError(f"{len(of)} windows of {len(low)} segments in one bucket")
                return of, least
            return match
        return with_limits
    monkeypatch.setattr(seed_extend, "match_by_extension", bounded(seed_extend.match_by_extension))
    monkeypatch.setattr(bwt, "match_by_merge", bounded(bwt.match_by_merge))
    texts = {i: f"own{i} " + "la vile. " * (150 + i) + f"after{i}" for i in range(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    units = {d: WORD.findall(t) if unit == "word" else t.encode() for d, t in texts.items()}
    gone = removed_brute(units, list(texts), 50)
    rows = (seed_extend.remove_repeated_passages if unit == "word" else bwt.remove_repeated_bytes)(df).collect()
    assert len(rows) == 12 and {r.doc_id: r.n_removed for r in rows} == {d: g.sum() for d, g in gone.items()}
    for r in rows:
        kept = [x for x, g in zip(units[r.doc_id], gone[r.doc_id]) if not g]
        assert (r.kept_text == " ".join(kept)) if unit == "word" else (bytes(r.kept) == bytes(kept))


def test_suffix_merge_equals_sorting():
    from credence.llm.bwt import match_by_merge
    segs = [bytes(RNG.integers(97, 99, 60).astype(np.uint8)) for _ in range(40)] + [b"ab" * 40, b"a" * 70]
    low = RNG.integers(0, 1000, len(segs))
    offsets = np.cumsum([0, *map(len, segs)])
    for window, shard in ((50, 200), (10, 1 << 18), (7, 97)):
        best = {}
        for s, m in zip(segs, low):
            for i in range(len(s) - window + 1):
                best[s[i: i + window]] = min(best.get(s[i: i + window], m), m)
        of, least = match_by_merge(window, shard, min(window, 5), 1 << 30)(np.frombuffer(b"".join(segs), np.uint8), offsets, low)
        assert least.tolist() == [best[s[i: i + window]] for s in segs for i in range(len(s) - window + 1)]
        assert of.tolist() == [k for k, s in enumerate(segs) for _ in range(len(s) - window + 1)]


def test_groups_of_keys_merge_like_all_segments_together():
    from credence.llm import arrays as A
    from credence.llm.bwt import GRAM, WINDOW, match_by_merge
    from credence.llm.repeats import Units, segments
    parts = [bytes(RNG.integers(97, 101, 300).astype(np.uint8)) for _ in range(30)]
    data = np.frombuffer(b"".join(parts[i] for i in RNG.integers(0, 30, 200)), np.uint8)
    u = Units("byte", data, np.array([0, len(data)]))
    _, first, windows, _ = segments(u, WINDOW, GRAM)
    size = windows + WINDOW - 1
    body, offsets, low = data[A.ranges(first, size)], np.concatenate([[0], np.cumsum(size)]), RNG.integers(0, 10_000, len(size))
    answers = [match_by_merge(WINDOW, shard, GRAM, group) for shard, group in ((1 << 17, 1 << 30), (3000, 10_000), (500, 2000), (1 << 17, 1))]
    of, least = answers[0](body, offsets, low)
    best = {}
    raw, starts = body.tobytes(), A.ranges(offsets[:-1], windows)
    for i, s in zip(of, starts.tolist()):
        best[raw[s: s + WINDOW]] = min(best.get(raw[s: s + WINDOW], 1 << 60), low[i])
    assert least.tolist() == [best[raw[s: s + WINDOW]] for s in starts.tolist()]
    for other in answers[1:]:
        assert (other(body, offsets, low)[1] == least).all()


def test_colliding_polynomials_do_not_collide_here():
    """Thue-Morse strings and their complements, as spans, words and grams; unequal contents of equal hashes stay apart."""
    from credence.llm import arrays as A
    text = ["".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(n)) for n in (64, 1024, 4096) for k in (0, 1)]
    data = np.frombuffer("".join(text).encode(), np.uint8)
    end = np.cumsum([len(t) for t in text])
    start = end - [len(t) for t in text]
    assert len(set(A.SpanHash(data)(start, end).tolist())) == 6
    symbols = A.byte_symbols(data)
    assert len(set(A.SpanHash(symbols)(start, end).tolist())) == 6
    assert len({A.gram_hash(A.byte_symbols(np.frombuffer(t.encode(), np.uint8)), 1024)[0] for t in text[2:4]}) == 2


def test_contents_of_equal_hashes_stay_apart(monkeypatch):
    from credence.llm import arrays as A
    monkeypatch.setattr(A.SpanHash, "__call__", lambda self, start, end: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"abcabcxyzab", np.uint8)
    start, end = np.array([0, 3, 6, 9, 0]), np.array([3, 6, 9, 11, 0])
    one, which = A.distinct_spans(data, start, end)
    raw = data.tobytes()
    assert [raw[start[one[w]]: end[one[w]]] for w in which] == [b"abc", b"abc", b"xyz", b"ab", b""]
    assert len({raw[start[i]: end[i]] for i in one[np.unique(which)]}) == 4


def test_null_and_repeated_ids_are_not_earlier(spark):
    from credence.llm.seed_extend import remove_repeated_passages
    from credence.llm.setsketch import near_duplicates
    df = spark.createDataFrame([(None, PASSAGE), (3, PASSAGE), (3, PASSAGE)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeated_passages(df).collect()) == [(0, 70), (3, 0), (3, 0)]
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(df).collect()) == [(0, 0, True), (3, 3, True), (3, 3, True)]


def components_brute(k, percent):
    sets = {}
    for d, t in TEXT.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[d] = {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {d: d for d in TEXT}
    for _ in TEXT:
        for a in TEXT:
            for b in TEXT:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {d: (len(sets[d]), comp[d]) for d in TEXT}


@pytest.mark.parametrize("k,percent,rows", [(3, 85, 5), (5, 80, 4)])
def test_setsketch_brute_force(docs, empty, k, percent, rows):
    from credence.llm.setsketch import near_duplicates
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, k, percent, rows).collect()}
    assert got == components_brute(k, percent)
    assert near_duplicates(empty).collect() == []


def test_setsketch_chain_across_components(spark):
    """Neighbours in a chain are near, ends are not: links that no common leader shows are found."""
    from credence.llm.setsketch import near_duplicates
    base = [f"t{i}" for i in range(400)]
    chain = [(i, " ".join(base[12 * i: 12 * i + 200])) for i in range(16)]
    rows = near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert {r.component_id for r in rows} == {0}


def test_likelihood_follows_jaccard():
    from credence.llm import arrays as A
    from credence.llm.setsketch import likely_jaccard, registers_of
    for shared, own in ((900, 50), (500, 250), (0, 500)):
        h = A.mix(np.arange(1, shared + 2 * own + 1, dtype=np.uint64))
        a, b = h[: shared + own], np.concatenate([h[:shared], h[shared + own:]])
        r = registers_of(np.concatenate([a, b]), np.array([0, len(a)]))
        j = likely_jaccard(r[:1], r[1:], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(j - shared / (shared + 2 * own)) < 0.18


def test_short_merges_side_by_side(monkeypatch):
    """Short pre-tokens are merged together as the heap merges each; the heap gets the long ones only."""
    P = pytest.importorskip("public_tokenizers")
    from credence.llm.bpe import SHORT, Codec
    c = Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    letters = "etaoinshr dlu\u00e9\u00df\u4e2d0".encode()
    tokens = [RNG.choice(list(letters), n).astype(np.uint8).tobytes() for n in RNG.integers(1, SHORT + 1, 3000)] + [b"a" * 64, b"ab" * 20, bytes(range(256))[:60], b"\xff"]
    assert c.merge_short(tokens) == [c.merge(t) for t in tokens]
    assert c.merge_short([]) == []
    heaped, merge = [], c.merge
    monkeypatch.setattr(c, "merge", lambda token: heaped.append(len(token)) or merge(token))
    text = ("qzxv jkwpq zzyxq " * 3 + "xqz" * 50).encode()
    ids, first = c.encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert b"".join(c.tokens[i] for i in ids) == text and heaped == [151]


def test_bpe_like_the_library(docs, empty):
    import public_tokenizers as P
    import tiktoken

    from credence.llm.bpe import decode_ids, encode_documents
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = encode_documents(docs, path, P.PATTERN, ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    for r in coded.collect():
        ids = enc.encode_ordinary(TEXT[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(TEXT[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: bytes(r.decoded).decode() for r in decode_ids(coded, path, P.PATTERN).collect()} == TEXT
    assert encode_documents(empty, path, P.PATTERN).collect() == []


def test_perfect_hash_is_minimal():
    from credence.llm import arrays as A
    from credence.llm.bpe import PerfectHash
    keys = A.mix(np.arange(5000, dtype=np.uint64))
    h = PerfectHash(keys)
    assert sorted(h.find(keys).tolist()) == list(range(5000))
    assert (h.find(A.mix(np.arange(5000, 9000, dtype=np.uint64))) == -1).all()


def check_packing(rows, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = {}
    for d, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        for i in range(0, len(ids), 2048):
            want[d, i // 2048] = (i, len(ids[i: i + 2048]), zlib.crc32(ids[i: i + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    return len(bins)


def test_packing(docs, empty):
    import public_tokenizers as P

    from credence.llm.packing import pack, token_pieces
    path = P.path("word_bpe_49k.json")
    check_packing(pack(token_pieces(docs, path)).collect(), TEXT)
    assert pack(token_pieces(empty, path)).collect() == []
    assert all(len(r.ids) == r.length for r in token_pieces(docs, path, with_ids=True).collect())


def test_added_tokens_inside_texts_are_one_id(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from credence.llm.packing import token_pieces
    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["end of text <|endoftext|> next <|startoftext|>x", "<|endoftext|><|endoftext|>", "It's<|startoftext|>'s <<|endoftext|>> end<|endof", "text|> <|EndOfText|> <|ENDOFTEXT|>", "", "Naïve<|endoftext|>\u0301e <|endoftext|"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in token_pieces(df, path, with_ids=True).collect()}
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert got[0] == [806, 539, 4160, 49407, 1131, 49406, 343, 0]


def test_two_smaller_pieces_replace_one():
    from credence.llm.packing import Plan
    plan = Plan({60: 2, 30: 1, 25: 2, 15: 2}, 100)
    assert plan.sequences == 3 and sum(len(v) for v in plan.slots.values()) >= 4


def test_fingerprints_brute_force(docs, empty):
    from credence.llm.iblt import fingerprint_versions
    ids = sorted(TEXT, reverse=True)
    after = {d: ids[(i + 1) % len(ids)] for i, d in enumerate(ids)}
    seen = {}
    for r in fingerprint_versions(docs).collect():
        t, x = TEXT[r.doc_id], TEXT[after[r.doc_id]]
        edited = t[: len(t) - len(t) // 3] + x[: len(t) // 3]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1) == (t.split() == x.split()) or t.split() == x.split()
    assert fingerprint_versions(empty).collect() == []


def test_peeling_recovers_differences():
    from credence.llm import arrays as A
    from credence.llm.iblt import differences
    h = A.mix(np.arange(1, 2001, dtype=np.uint64))
    a, b = np.concatenate([h[:500], h[:900]]), np.concatenate([h[5:505], h[1000:1900]])
    pair, x, side = differences((a, np.array([0, 500, 1400])), (b, np.array([0, 500, 1400])))
    for p, (u, v) in enumerate(((a[:500], b[:500]), (a[500:], b[500:]))):
        assert set(x[(pair == p) & (side == 1)].tolist()) == set(u.tolist()) - set(v.tolist())
        assert set(x[(pair == p) & (side == -1)].tolist()) == set(v.tolist()) - set(u.tolist())


def test_network_is_a_distribution_and_learns(spark, docs, empty):
    from credence.llm import lm
    net = lm.Network()
    around = RNG.integers(0, lm.CODES, (2, 2 * lm.SIDE))
    for row in around:
        log_p = net.forward(np.repeat(row[None], lm.CODES, axis=0), np.arange(lm.CODES))[0]
        assert np.exp(log_p).sum() == pytest.approx(1, abs=1e-4)
    train = spark.createDataFrame([(i, "red green blue black white " * 80) for i in range(40)], "doc_id long, text string").repartition(2)
    held = spark.createDataFrame([(1, "green blue black white red green blue"), (2, "blue blue white white red red green"), (3, None)], "doc_id long, text string")
    scores = {r.doc_id: r for r in lm.score_documents(held, lm.fit(train, rounds=1, passes=3)).collect()}
    assert scores[1].per_word > scores[2].per_word > -np.log(lm.CODES)
    assert scores[3].pseudo_log_likelihood == 0 and scores[3].per_word is None
    rows = lm.score_documents(docs).collect()
    assert {r.doc_id: r.n_words for r in rows} == {d: len(WORD.findall(t)) for d, t in TEXT.items()}
    assert lm.score_documents(empty).collect() == []


def test_network_gradient_equals_finite_differences():
    from credence.llm import lm
    net = lm.Network(np.random.default_rng(1).normal(0, 0.3, lm.SIZE), lm.digit_shares(RNG.integers(0, 50, lm.CODES)))
    around, code = RNG.integers(0, lm.CODES + 1, (64, 2 * lm.SIDE)), RNG.integers(0, lm.CODES, 64)
    grad, at = net.gradient(around, code), 0
    places = []
    for name, shape in lm.SHAPES.items():
        n = int(np.prod(shape))
        places += (at + np.argsort(-np.abs(grad[at: at + n]))[:3]).tolist()
        at += n
    for i in places:
        def loss(step, i=i):
            moved = lm.Network(net.vector, net.shares)
            moved.vector[i] += step
            return -moved.forward(around, code)[0].mean()
        assert (loss(1e-2) - loss(-1e-2)) / 2e-2 == pytest.approx(grad[i], rel=0.03, abs=2e-4)


def test_untrained_network_is_the_share_of_the_counts():
    from credence.llm import lm
    seen = RNG.integers(0, 9, lm.CODES)
    around, code = RNG.integers(0, lm.CODES + 1, (200, 2 * lm.SIDE)), RNG.integers(0, lm.CODES, 200)
    log_p = lm.Network(None, lm.digit_shares(seen)).forward(around, code)[0]
    np.testing.assert_allclose(log_p, np.log((seen[code] + 1) / (seen + 1).sum()), atol=1e-5)


def test_held_out_words_are_likelier_than_by_their_counts(spark):
    from dataclasses import replace

    from credence.llm import lm
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4, "doc_id")
    model = lm.fit(docs.where("doc_id % 5 <> 0"), passes=3)
    held = docs.where("doc_id % 5 = 0")
    by_counts = replace(model, vector=lm.Network().vector)
    trained, counted = (lm.score_documents(held, m).selectExpr("sum(pseudo_log_likelihood) / sum(n_words) AS per_word").first().per_word for m in (model, by_counts))
    assert trained > counted + 0.01


def test_words_of_one_code_have_their_own_probability(spark):
    from credence.llm import arrays as A
    from credence.llm import lm

    def code(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return int(lm.codes_of(A.Words(data, np.array([0, len(data)])).symbol)[0])
    alike = [w for w in (f"x{i}" for i in range(40_000)) if code(w) == code("green")][:3]
    train = spark.createDataFrame([(i, f"red green blue {alike[0] if i == 7 else ''}") for i in range(30)], "doc_id long, text string").repartition(2)
    model = lm.fit(train)
    assert {r.word.decode(): r.times for r in model.counts.collect()} == {"red": 30, "green": 30, "blue": 30, alike[0]: 1}
    share = lambda times, c: np.exp(model.log_share(np.array([times]), np.array([c])))[0]
    for c, seen in ((code("green"), (30, 1)), (code("red"), (30,)), ((code("red") + 1) % lm.CODES, ())):
        assert sum(share(n, c) for n in seen) + model.codes[2, c] * share(0, c) == pytest.approx(1)
    held = spark.createDataFrame([(1, "red green blue"), (2, f"red {alike[0]} blue"), (3, f"red {alike[1]} blue"), (None, f"red {alike[2]} blue")], "doc_id long, text string")
    got = {r.doc_id: r.pseudo_log_likelihood for r in lm.score_documents(held, model).collect()}
    assert got[1] - got[2] == pytest.approx(np.log(30), abs=1e-5) and got[2] >= got[3] - 1e-9 and got[3] == pytest.approx(got[None])


def test_quality_edge_rows(docs, empty):
    from credence.llm.quality import quality_rules
    for r in quality_rules(docs).collect():
        t = TEXT[r.doc_id]
        w = WORD.findall(t)
        grams = [tuple(w[i: i + 3]) for i in range(len(w) - 2)]
        hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules(empty).collect() == []


def test_url_rules(spark):
    from credence.llm.urls import judge_urls, rule_table
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("a.example.net/en/x", "block"), ("org/fr/", "allow"), ("com/", "block"), ("b.com/", "allow"), ("b.com/q/", "block")]
    urls = [None, "", "nohost", "http://x.net", "http://X.NET/a?b", "https://www.example.net/en/1#t", "https://a.example.net/en/xyz", "https://zexample.net/en/", "https://example.net/de/",
            "http://b.com/q/1", "http://c.b.com/r", "http://org/fr/", "http://net.org/en", "://h.org/fr/?x", "http://a.com:80/", "http://bb.com/", "http:///net/"] * 2
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")

    def plain(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = host.lower()
        fit = [(len(r), r, v) for r, v in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow"
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rule_table(spark, rules)).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert {r.verdict for r in judge_urls(pages, rule_table(spark, rules).limit(0)).collect()} == {"allow"}
    assert judge_urls(pages.limit(0), rule_table(spark, rules)).collect() == []


def test_warc_derivatives(spark, tmp_path):
    from credence.llm import warc
    page = "<html><head><title>A &amp; b</title><script>var x='<p>';</script></head><body><!-- no --><p>One <b>two</b></p><a href='/x?a=1&amp;b'>three</a> 1 < 2</body>"
    pages = spark.createDataFrame([(1, "http://h/1", page), (2, None, None), (3, "http://h/3", "plain"), (1, "http://h/1", page)], "page_id long, url string, html string")
    responses = warc.page_responses(pages)
    rows = warc.derive(responses).collect()
    assert len(rows) == 8
    source = {r.page_id: warc.parse_record(bytes(r.record))[0] for r in responses.collect()}
    for r in rows:
        fields, block = warc.parse_record(bytes(r.record))
        assert fields["WARC-Refers-To"] == r.refers_to == source[r.page_id]["WARC-Record-ID"]
        assert r.source_digest == source[r.page_id]["WARC-Payload-Digest"] and fields["WARC-Type"] == r.kind
        assert block == bytes(r.block) and fields["WARC-Block-Digest"] == warc.digest(block)
    text = {r.page_id: bytes(r.block).decode() for r in rows if r.kind == "conversion"}
    assert text == {1: "A & b\nOne two\nthree 1 < 2", 2: "", 3: "plain"}
    assert {r.n_links for r in rows if r.page_id == 1} == {1} and {r.title for r in rows if r.page_id == 1} == {"A & b"}
    members = warc.gzip_members(responses).collect()
    (tmp_path / "x.warc.gz").write_bytes(b"".join(bytes(m.member) for m in members))
    back = warc.read_warc(spark, str(tmp_path))
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes(m.record) for m in members)
    assert warc.derive(responses.limit(0)).collect() == []


def test_derivatives_query_makes_whole_records(spark):
    from credence.llm import warc
    from credence.llm.registry import QUERIES
    made = {}
    for r in warc.page_responses(spark.read.parquet(f"{SF001}/pages.parquet")).collect():
        fields, block = warc.parse_record(bytes(r.record))
        for what, *_, out, whole in warc._derived(fields, block, True):
            named, content = warc.parse_record(whole)
            assert named["WARC-Type"] == what and named["Content-Length"] == str(len(out)) and content == out
            made[r.page_id, what] = (len(whole), hashlib.sha256(whole).hexdigest())
    rows = QUERIES["op4_derivatives"](spark, SF001).collect()
    assert rows and {(r.page_id, r.kind): (r.record_length, r.record_sha256) for r in rows} == made


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline
    from credence.llm.quality import quality_rules
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    sets = {}
    for d, t in texts.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[d] = {tuple(w[i: i + 5]) for i in range(len(w) - 4)}
    comp = {d: d for d in texts}
    ids = sorted(texts)
    for _ in range(3):
        for a in ids:
            for b in ids:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    texts = {d: t for d, t in texts.items() if comp[d] == d}
    units = {d: WORD.findall(t) for d, t in texts.items()}
    gone = removed_brute(units, list(texts), 50)
    left = {d: t if not gone[d].any() else " ".join(w for w, g in zip(units[d], gone[d]) if not g) for d, t in texts.items() if not len(gone[d]) or not gone[d].all()}
    check_packing(corpus_pipeline.run(spark, SF001).collect(), left)


def test_stages_keep_columns_and_take_empty_tables(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF001)
        assert docs.columns == corpus_pipeline.COLUMNS and docs.collect() == []
