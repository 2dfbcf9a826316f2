"""The training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import random
import re
import textwrap
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F


from millrace.llm import bpe, chat, embedding, licenses, mixing, packing, quality, simhash, substring, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, body string"
CLEAN = """Late in the autumn the ferry stopped calling at the island, and those who had stayed
counted their stores again. Nobody spoke of the winter before; it was enough to mend the nets, to
stack peat beside each door and to light one lamp in the harbour window every evening. When a boat
did come, in the second week of January, its crew found bread, warm soup and a table already laid."""
RANKS = P.path("byte_bpe_50k.tiktoken")
VOCABULARIES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None if k % 5 == 4 else "en", None if k % 4 == 3 else f"s{k % 3}", None, "x") for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [" ".join(rng.choices(vocab, k=rng.randint(14, 60))) for _ in range(4)]
    out = []
    for k in range(n):
        words = rng.choices(vocab, k=rng.randint(1, 150))
        if k % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = rng.choice(shared).split()
        out.append("  ".join(words[:3]) + "\n" + " ".join(words[3:]))
    return out + [out[0], out[5], out[5], "", None, " \t\n", "one", "two words", "a b c " * 4000, "É ünï " * 30]


def brute_components(linked):
    label = np.arange(len(linked))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            return label
        label = new


def slow_fingerprint(text):
    """From the contract alone."""
    import xxhash

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    votes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def test_fingerprints_are_the_contracts(spark):
    texts = corpus(30) + ["a", "A b", "A B c", "a\x0bb\x0cc d", "É é À\u00a0x y z", "a b c a b c", "\x1ca b", "İ I i", "a b"]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).select("doc_id", simhash.hex16(F.col("fp")).alias("fp")).collect()}
    assert [got[i].fp for i in range(len(texts))] == [f"{slow_fingerprint(t):016x}" for t in texts]


def test_pivots_discard_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(base[rng.integers(0, 40, 600)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (600, 2), dtype=np.uint64), axis=1))
    fp = fp[np.argsort(np.bitwise_count(fp ^ simhash.PIVOTS[0]), kind="stable")]
    i, j = simhash.near(fp, np.full(len(fp), len(fp)), simhash.coordinates(fp), None, 3)
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if int(fp[a] ^ fp[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) > 100


def test_simhash(spark):
    texts = corpus()
    base = texts[1].split()
    texts += [" ".join(base + [f"x{i}"]) for i in range(40)]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    want = brute_components(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    assert [got[i].component_id for i in range(len(texts))] == want.tolist()
    assert simhash.fingerprint(None) == 0 == simhash.fingerprint(" \n")


def test_simhash_chunks_lose_nothing(spark):
    rng = np.random.default_rng(0)
    fp = np.unique(np.uint64(12345) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (700, 2), dtype=np.uint64), axis=1))
    classes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    from millrace.llm.common import components

    got = {r.node: r.component for r in components(simhash.links(classes)).collect()}
    want = brute_components(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    names = [got.get(int(x), int(x)) for x in fp.view(np.int64)]
    assert len(set(zip(names, want))) == len(set(names)) == len(set(want))


def test_similar_texts(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rng.choices(vocab, k=300) for _ in range(40)]
    texts = [" ".join(w) for w in base]
    for w in base[:20]:
        for places in ([7], [3, 250]):  # similarities of about 0.97 and 0.93
            other = list(w)
            for p in places:
                other[p] = "X"
            texts.append(" ".join(other).upper())
    texts += [" ".join(w[:150] + rng.choices(vocab, k=150)) for w in base[:20]]  # about a third
    texts += [texts[0], texts[39], "", None, " \t", "a b", "A  B", "c"]
    got = {r.doc_id: r.component_id for r in simhash.similar(docs(spark, texts)).collect()}
    want = list(range(40)) + [i for i in range(20) for _ in range(2)] + list(range(80, 100)) + [0, 39, 102, 102, 102, 105, 105, 107]
    assert got == dict(enumerate(want))
    none = spark.createDataFrame([(None,) * 6] * 2 + [(3, None, None, None, None, None), (3, "a b c", None, None, None, None)], DOCS)
    assert [tuple(r) for r in simhash.similar(none).collect()] == [(3, 3)] and simhash.similar(docs(spark, [])).count() == 0
    g, d = simhash.shingles(__import__("pyarrow").array(["a b C d e f", None, "a B c d e"]), 5)
    assert d.tolist() == [0, 0, 2] and g[0] == g[2] != g[1]


def test_similar_groups_in_chunks(spark):
    rng = random.Random(9)
    base = rng.choices([f"w{i}" for i in range(3000)], k=200)
    texts = [" ".join(base[:k % 200] + [f"x{k}"] + base[k % 200 + 1 :]) for k in range(700)]
    got = simhash.similar(docs(spark, texts)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 700


def test_similar_is_brute_force_on_a_crowd(spark):
    """Texts about one template at similarities on both sides of 0.8, in buckets of many chunks."""
    rng = random.Random(10)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(260):
        words = list(base)
        for p in rng.sample(range(0, 150, 5), rng.choice([1, 2, 3, 5, 8])):
            words[p] = f"x{k}y{p}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    linked = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    want = brute_components(linked)
    assert 3 < len(set(want.tolist())) < 200
    for chunk in (8, 50, 1000):
        got = {r.doc_id: r.component_id for r in simhash.similar(docs(spark, texts), chunk=chunk).collect()}
        assert [got[i] for i in range(260)] == want.tolist(), chunk


def changed(words, places, tag):
    out = list(words)
    for p in places:
        out[p] = f"{tag}{p}"
    return out


def test_similar_verifies_every_candidate(spark):
    texts, want = [], []
    for seed in range(8):
        rng = random.Random(seed)
        words = [f"g{seed}x{i}" for i in range(304)]
        spots = rng.sample(range(5, 300, 6), 40)
        at = len(texts)
        texts += [" ".join(changed(words, rng.sample(spots, 10), f"n{k}x")) for k in range(12)]  # about 0.71 to the last one
        texts += [" ".join(changed(words, rng.sample(spots, 6), "t")), " ".join(words)]  # 0.82
        want += [*range(at, at + 12), at + 12, at + 12]
    got = {r.doc_id: r.component_id for r in simhash.similar(docs(spark, texts)).collect()}
    assert got == dict(enumerate(want))


def test_similar_joins_clusters_beyond_their_hubs(spark):
    texts, ids = [], []
    for seed in range(4):
        words = [f"g{seed}x{i}" for i in range(304)]
        spots = random.Random(seed).sample(range(5, 300, 6), 17)
        a, b, c = spots[:6], spots[6:12], spots[12:]
        texts += [" ".join(x) for x in (changed(words, a, "a"), changed(changed(words, b, "b"), c, "c"), words, changed(words, b, "b"))]  # 1~3, 3~4, 4~2 and no more
        ids += [10 * seed + k for k in (1, 2, 3, 4)]
    got = {r.doc_id: r.component_id for r in simhash.similar(docs(spark, texts, ids)).collect()}
    assert got == {i: i // 10 * 10 + 1 for i in ids}


def test_similar_keeps_forms_with_other_values(spark):
    rng = random.Random(4)
    texts = ["\n".join(f"sensor reading from the north station was {rng.randrange(10**9)}" for _ in range(n)) for n in (50, 50, 50, 200, 200, 400)]
    kept = quality.filtered(docs(spark, texts), *VOCABULARIES)
    assert {r.doc_id: r.component_id for r in simhash.similar(kept).collect()} == {i: i for i in range(len(texts))}


def brute_substring(rows, window=13):
    low, out = {}, {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            low[k] = min(low.get(k, d), d)
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if low[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = len(w), sum(gone), hashlib.sha256(kept).hexdigest()
    return out


def test_substring(spark):
    texts = corpus()
    rows = list(zip(range(len(texts)), texts))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(docs(spark, texts), digests=True).collect()}
    assert got == brute_substring(rows)
    new = {r.doc_id: r for r in substring.rewritten(docs(spark, texts)).collect()}
    assert all(new[i].text == t for i, t in rows if not got[i][1]) and new[0].body == "x"


def test_substring_tells_crafted_words_apart(spark):
    thue = "a"
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    for n in (16, 512, 1024, 2048):  # equal under any polynomial modulo 2**64 from about 2**10 letters on
        rest = " ".join(f"w{i}" for i in range(12))
        rows = substring.dedup(docs(spark, [f"{thue[:n]} {rest}", f"{other[:n]} {rest}", f"{thue[:n]} {rest}"])).collect()
        assert {r.doc_id: r.n_removed for r in rows} == {0: 0, 1: 0, 2: 13}


def test_substring_keeps_columns_of_any_name(spark):
    df = docs(spark, corpus(20)).withColumn("shard", F.lit("mine")).withColumn("To", F.lit(3)).withColumn("_shard", F.lit(1))
    got = substring.rewritten(df)
    assert got.columns == df.columns and {(r["shard"], r["To"], r["_shard"]) for r in got.collect()} == {("mine", 3, 1)}


def test_embedding(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    x = np.concatenate([centre[i % 6] + rng.normal(size=16) * s for i, s in zip(range(240), np.tile([0.02, 0.1, 0.3, 1.0], 60))] + [centre[0]] * 5).reshape(-1, 16).astype(np.float32)
    label = np.arange(len(x)) % 2
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, x[0].tolist(), None), (904, [None] + [1.0] * 15, 0), (905, [], 0), (906, [float("inf")] * 16, 0)]
    got = {r.vec_id: r for r in embedding.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    want = brute_components(linked)
    assert [got[i].n_links for i in range(len(x))] == (linked.sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(len(x))] == want.tolist()
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i, _, _ in odd)


def test_embedding_tiles_lose_nothing(spark):
    rng = np.random.default_rng(11)
    n, d = 20_000, 64
    x = rng.normal(size=(n, d)) / 8
    group = rng.integers(0, 300, n)
    near = rng.random(n) < 0.2
    x[near] = x[group[near]] + rng.normal(size=(near.sum(), d)) / 8 * rng.choice([0.1, 0.25, 0.28, 0.3], (near.sum(), 1))
    x = x.astype(np.float32)
    label = np.where(near, group % 3, rng.integers(0, 3, n))
    label[:300] = np.arange(300) % 3
    rows = spark.createDataFrame(__import__("pandas").DataFrame({"vec_id": np.arange(n), "embedding": x.tolist(), "label": label}), "vec_id long, embedding array<float>, label int")
    got = embedding.near_duplicates(rows, tile=1000).toPandas().sort_values("vec_id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links, want = np.zeros(n, int), np.arange(n)
    for c in range(3):
        at = np.flatnonzero(label == c)
        linked = u[at] @ u[at].T >= 0.93
        links[at], want[at] = linked.sum(1) - 1, at[brute_components(linked)]
    assert links.sum() > 10_000 and got.n_links.tolist() == links.tolist() and got.component_id.tolist() == want.tolist()


def test_embedding_far_tiles_do_not_meet(spark):
    rng = np.random.default_rng(12)
    centre = rng.normal(size=(8, 64))
    rows = [(i, (centre[i % 8] + rng.normal(size=64) * 0.02).tolist(), 0) for i in range(800)]
    one = [pa.array([64] * 2, pa.int32()), *(pa.array([x.astype(np.float32).tobytes()] * 2, pa.binary()) for x in (centre[0], centre[0] + 0.01))]
    far = [pa.array([x.astype(np.float32).tobytes(), (x * 3).astype(np.float32).tobytes()], pa.binary()) for x in (centre[1] - 9, centre[1] - 8.9)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), *one, *far], names=["a", "b", "d", "low", "high", "low2", "high2"])
    assert [b.num_rows for b in embedding._near_tiles(0.93)([batch])] == [0]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=64).collect()
    assert {(r.vec_id, r.component_id, r.n_links) for r in got} == {(i, i % 8, 99) for i in range(800)}
    huge = [(0, [1e300, 1e300], 0), (1, [1e-300, 1e-300], 0), (2, [-1e300, 1e300], 0)]
    got = embedding.near_duplicates(spark.createDataFrame(huge, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.component_id, r.n_links) for r in got) == [(0, 0, 1), (1, 0, 1), (2, 2, 0)]


def test_bpe_is_tiktokens(spark):
    c = bpe.codec(RANKS, P.PATTERN)
    same = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(2)
    texts = ["", " ", "a  b", "a\n \nb", "a \n b\t\tc  ", "don't 'S 12345", "日本語テキスト 🎉👩‍👩‍👧", "aaaa" * 300, "<|endoftext|>", "a\x1c b\xa0 c\u3000d"]
    alphabet = ["a", "bc", "É", "é", "ª", "ʰ", "ɐ", "ж", "7", ".", "'", "'s", "_", "%%", "-", "\n", "\n\n", " ", "  ", "\x0b", "\x1c", "\u2028", "\xa0", "word", "'t,"]
    texts += ["".join(rng.choices(alphabet, k=400)) for _ in range(60)] + [" ".join("".join(rng.choices(alphabet, k=4)) for _ in range(200)) for _ in range(40)] + ["a\nb" * 3000, "a" * 5000 + ".\n"]
    texts += ["".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(400)) for _ in range(20)] + ["".join(rng.choice("abcdeABC \n'1.") for _ in range(3000)) for _ in range(20)]
    for t in texts:
        want = same.encode_ordinary(t)
        assert c.encode(t) == want and c.decode(want).decode() == t
        assert c.digests(t) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    rows = {r.doc_id: r for r in bpe.encode(docs(spark, texts + [None]), RANKS, P.PATTERN).collect()}
    assert all(bytes(rows[i].decoded).decode() == t for i, t in enumerate(texts)) and rows[len(texts)].ids == []


def test_bpe_under_other_patterns_and_ranks():
    ranks = bpe.read_ranks(RANKS)
    camel = r"[A-Z]?[^A-Z]+|[A-Z]"
    texts = ["camelCaseWords in AText, HTTPServer 12", "  Two  SPACES a  b", "", "éÉ ñÑ"]
    more = ranks | {b" qzxj": 50300, b"zqxj": 50301}  # no merges make these
    for pattern, r in ((camel, ranks), (P.PATTERN, more), (camel, more)):
        c = bpe.Codec(r, pattern)
        same = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=r, special_tokens={})
        for t in texts + ["a qzxj zqxj qzxjqzxj", "zqxj", "Azqxj zqxjzqxj"]:
            want = same.encode_ordinary(t)
            assert c.encode(t) == want and c.digests(t)[0] == len(want) and c.decode(want).decode() == t


def test_bpe_takes_tokens_of_any_length(tmp_path):
    import base64

    ranks = {bytes([i]): i for i in range(256)} | {b"a" * 2**k: 255 + k for k in range(1, 11)}
    path = tmp_path / "long.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + f" {i}\n".encode() for t, i in ranks.items()))
    c = bpe.codec(str(path), P.PATTERN)
    same = tiktoken.Encoding("long", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for n in (255, 257, 600, 1500, 2100):
        assert c.encode("a" * n) == same.encode_ordinary("a" * n)


def test_mixing(spark):
    rng = random.Random(5)
    texts = [" ".join(["w"] * rng.randint(0, 40)) or None for _ in range(800)]
    df = docs(spark, texts)
    a, b = (sorted(map(tuple, mixing.mix(df).collect()), key=lambda r: r[0]) for _ in range(2))
    assert a == b
    rows = mixing.mix(df).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r.size and r.size == len((texts[r.doc_id] or "").split())
    goal = {r.source: r.target for r in rows}
    assert all(abs(taken[s] - goal[s]) <= 40 for s in sizes) and abs(sum(goal.values()) - sum(sizes.values())) < 1e-6
    of = lambda *rows: {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, n long")).collect()}
    assert of(("a", 100), ("b", 1), (None, 1)) == {"a": 96.0, "b": 3.0, None: 3.0} and of((None, 0)) == {None: 0.0}
    many = of(*[(f"s{i:04}", i) for i in range(2000)])
    assert abs(sum(many.values()) - 1999 * 1000) < 1e-3 and all(many[f"s{i:04}"] <= 3 * i for i in range(2000))
    assert mixing.mixed(df).count() == sum(r.copies for r in rows if r.size)


def brute_mix(sizes_of, hashes, weights=(1, 2, 3), most=3):
    """By row the copies, from the contract: targets by repeated capping, then the best threshold over all sorted hashes."""
    total = {}
    for s, n in sizes_of:
        total[s] = total.get(s, 0) + n
    order = sorted([s for s in total if s is not None]) + [None] * (None in total)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(total.values()) - sum(most * total[s] for s in capped)
        open_ = sum(weight[s] for s in order if s not in capped)
        target = {s: most * total[s] if s in capped else left * weight[s] / open_ for s in order} if open_ else {s: most * total[s] for s in order}
        over = {s for s in order if s not in capped and target[s] > most * total[s]}
        if not over:
            break
        capped |= over
    best = {}
    for s in order:
        rows = sorted((h, n) for (t, n), h in zip(sizes_of, hashes) if t == s and n)
        taken = [0] + list(np.cumsum([n for _, n in rows]))
        whole = min(most, int(target[s] // total[s])) if total[s] else 0
        rest = target[s] - whole * total[s] if whole < most else 0
        best[s] = target[s], whole, min((abs(t - rest) for t in taken)) if rows else 0
    return best


def test_mixing_is_the_brute_force(spark):
    rng = random.Random(6)
    for n, seed in ((1, 1), (7, 2), (300, 3)):
        texts = [" ".join(["w"] * rng.choice([0, 1, 5, 40, 400])) or None for _ in range(n)] + ["w " * 300] * 3
        df = docs(spark, texts)
        rows = mixing.mix(df).collect()
        want = brute_mix([(r.source, r.size) for r in rows], [0] * len(rows))
        hashed = {r.doc_id: r.h for r in mixing.sized(df).collect()}
        want = brute_mix([(r.source, r.size) for r in rows], [hashed[r.doc_id] for r in rows])
        for s in {r.source for r in rows}:
            mine = [r for r in rows if r.source == s]
            target, whole, off = want[s]
            assert all(abs(r.target - target) < 1e-6 and r.copies in (whole, whole + 1) for r in mine)
            assert abs(abs(sum(r.taken for r in mine) - target) - off) < 1e-6
            more = [hashed[r.doc_id] for r in mine if r.size and r.copies > whole]
            less = [hashed[r.doc_id] for r in mine if r.size and r.copies == whole]
            assert not more or not less or max(more) < min(less)


def test_mixing_keeps_columns_of_any_name(spark):
    df = docs(spark, corpus(30)).withColumn("__h", F.lit("mine")).withColumn("__copy", F.lit(2)).withColumn("H", F.lit(3)).withColumn("copies", F.lit(4)).withColumn("s", F.lit(5)).withColumn("low", F.lit(6))
    got = mixing.mixed(df)
    assert got.columns == df.columns and {(r["__h"], r["__copy"], r["H"], r["copies"], r["s"], r["low"]) for r in got.collect()} == {("mine", 2, 3, 4, 5, 6)}


def test_quality(spark):
    line = "the quick brown fox jumps over a lazy dog again"
    texts = [line + "\n" + line + "\n\n" + line, " ".join(f"word{i} &" for i in range(40)), None, "", "ab #é\n", "\ufffd\u0bf5\u1234 " * 100, CLEAN]
    got = {r.doc_id: r for r in quality.rules(docs(spark, texts), *VOCABULARIES).collect()}
    assert (got[0].n_words, got[0].n_dup_lines, got[0].n_repeat_words, got[0].base_failed) == (30, 2, 30, True)
    assert (got[1].n_symbols, got[1].n_repeat_words, got[1].base_failed) == (40, 0, False)
    assert got[1].token_entropy < 3 and not got[1].kept  # forty times the same few tokens
    assert got[6].kept
    assert got[2].base_failed and got[3].n_words == 0 and (got[4].word_chars, got[4].n_symbols) == (4, 1)
    assert got[5].fallback_share > 0.5 and not got[5].kept
    kept = quality.filtered(docs(spark, texts), *VOCABULARIES)
    assert [r.doc_id for r in kept.collect()] == [i for i in got if got[i].kept] and kept.columns == docs(spark, []).columns


def test_quality_bands_tell_junk(spark):
    rng = random.Random(3)
    text = lambda word, n: " ".join(word(CLEAN.split()[k % 60]) for k in range(n))
    letters = lambda w: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    syllables = lambda w: "".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"], k=3)) + rng.choice(["###", "$$$", "%%%", "***", "&&&"])
    texts = [text(letters, 30), text(letters, 300), text(syllables, 300), CLEAN, " ".join(CLEAN.split()[:24])]
    got = {r.doc_id: r for r in quality.rules(docs(spark, texts).withColumn("lang", F.lit("en")), *VOCABULARIES).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[i].kept for i in range(5)] == [False, False, False, True, True], got


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("system", "s"), ("user", f"q{c % 3}"), ("assistant", said), ("user", f"r{c % 7}"), ("assistant", None)][: 2 + c % 4])]
    rows += [(99, t, "assistant", f"\\{t}</turn>\n###") for t in range(500)] + [(None, None, None, None), (98, 0, "a:\n\\b", "x"), (98, 0, "a:\n\\b", "x")]
    rows += [(97, 0, "a\0b", "c"), (96, 0, "a", "b\0c"), (95, 0, "user", "long " * 60_000), (94, 0, "a0:", ""), (93, 0, "a", "0:")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("Path", F.lit(1)).withColumn("turns", F.lit("x"))
    nodes, paths, members = chat.tree(table, RANKS, P.PATTERN)
    got = {r.conv_id: r for r in chat.read_back(nodes, paths, members).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", x or "") for _, r, x in sorted((t or 0, r or "", x or "") for k, t, r, x in rows if k == c)]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    tree = sorted(nodes.collect(), key=lambda r: r.start)
    assert all(a.end == b.start for a, b in zip(tree, tree[1:])) and tree[0].start == 0
    assert all(n.position == sum(s["to"] - s["from"] for s in n.ancestors) for n in tree)
    assert len(tree) == len({(tuple(map(tuple, n.ancestors)), n.text) for n in tree})
    c = bpe.codec(RANKS, P.PATTERN)
    assert all(a.token_end == b.token_start for a, b in zip(tree, tree[1:])) and tree[0].token_start == 0
    at = {n.start: n for n in tree}
    for n in tree:
        assert c.decode(n.ids).decode() == n.text and n.token_end - n.token_start == len(n.ids)
        assert n.token_position == sum(s["to"] - s["from"] for s in n.token_ancestors)
        assert (n.loss_from is None) == (n.token_loss_from is None)
        if n.loss_from is not None:
            assert c.decode(n.ids[n.token_loss_from : n.token_loss_to]).decode() == n.text[n.loss_from : n.loss_to]
    for p in paths.collect():  # a path's tokens, and what its last node attends to, are one conversation's
        way = [at[s["from"]] for s in p.spans]
        seen = {t for s in way[-1].token_ancestors for t in range(s["from"], s["to"])}
        assert seen == {t for n in way[:-1] for t in range(n.token_start, n.token_end)}
    empty = table.where("conv_id = 12345")
    assert chat.read_back(*chat.tree(empty, RANKS, P.PATTERN)).count() == 0


def test_licenses(spark):
    mit = "Copyright (c) 2020 Some One\n\n" + licenses._MIT.upper().replace("\n\n", "\n \n")
    got = [r.license for r in licenses.scan(docs(spark, [mit, mit + " and more", None, "", "!!!", "released under the  MIT Licence"])).orderBy("doc_id").collect()]
    assert got == ["MIT", None, None, None, None, "MIT"]


def test_licenses_are_found_at_any_width(spark):
    def rewrapped(text, width):
        notice = re.compile(r"\W*copyright (\(c\)|\[|\d)|\W*all rights reserved\W*$", re.I)
        parts, rest = [], []
        for line in text.split("\n") + [""]:
            if not line.strip() or notice.match(line):
                parts += [textwrap.fill(" ".join(rest), width, break_on_hyphens=False, break_long_words=False)] + [line]
                rest = []
            else:
                rest += line.split()
        return "Copyright 2020 Some One <a@b.example>\n" + "\n".join(parts)

    cases = [(n, rewrapped(t, w)) for n, t in licenses.KNOWN for w in (40, 55, 66, 72, 79, 100, 10**6)]
    got = {r.doc_id: r.license for r in licenses.scan(docs(spark, [t for _, t in cases])).collect()}
    assert [(i, n) for i, (n, _) in enumerate(cases) if got[i] != n] == []
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSL-1.0", "CC0-1.0", "Unlicense", "Zlib"} <= {n for n, t in licenses.KNOWN if len(t) > 500}
    notices = ["Copyright (c) 2020 A", "copyright The Foo Authors", "(C) 1999 B", "  * Copyright: C", "\u00a9 D", "Copyright 2001-2003, E", "All rights reserved."]
    assert {r.license for r in licenses.scan(docs(spark, [x + "\n" + licenses._MIT for x in notices])).collect()} == {"MIT"}


def slow_pack(texts, encode, length, end, pad):
    """By matrix row: [(text, part, ids)], rows in the order in which they are opened, from the contract alone."""
    parts = []
    for i, t in texts:
        ids = encode(t or "") + [end]
        parts += [(i, p, ids[p * length : (p + 1) * length]) for p in range(-(-len(ids) // length))]
    rows = []
    for part in sorted(parts, key=lambda x: -len(x[2])):
        rooms = [(length - sum(len(x[2]) for x in row), k) for k, row in enumerate(rows)]
        fits = [r for r in rooms if r[0] >= len(part[2])]
        least = min(r[0] for r in fits) if fits else 0
        at = [k for r, k in fits if r == least]
        rows.append([part]) if not fits else rows[at[-1]].append(part)
    return rows


def test_packing(spark):
    texts = corpus(20) + ["word " * 9000, "x" * 5000, "x" * 511, "é" * 9000, " " * 4000 + "a"]
    c = bpe.codec(RANKS, P.PATTERN)
    parts, used = {}, []
    for row in packing.pack(docs(spark, texts), RANKS, P.PATTERN, length=512).collect():
        r = row.asDict()
        n = r["n_rows"]
        assert 2 * n * 512 == len(r["ids"]) and max(r["cu_seqlens"]) <= 512
        matrix, where = np.frombuffer(r["ids"], "<u2").reshape(n, 512), packing.positions(np.array(r["resets"]), n * 512).reshape(n, 512)
        at = [0] * n
        for k, (d, p, ids) in enumerate(packing.unpack(r)):
            m, row_ = len(ids), r["seg_row"][k]
            assert r["seg_length"][k] == m and r["cu_seqlens"][k] == at[row_] + m
            assert where[row_, at[row_] : at[row_] + m].tolist() == list(range(m))
            at[row_] += m
            parts[d, p] = ids
        for row_, n_used in enumerate(at):
            assert (matrix[row_, n_used:] == 50256).all() and where[row_, n_used:].tolist() == list(range(512 - n_used))
        mine = sorted({d for d in r["doc_id"]})
        used.append(n)
        want = slow_pack([(i, texts[i]) for i in mine], c.encode, 512, 50256, 50256)
        assert len(want) == n and sorted(512 - sum(len(x[2]) for x in row) for row in want) == sorted(512 - x for x in at)
    for i, t in enumerate(texts):
        ids = [x for p in range(len(parts)) if (i, p) in parts for x in parts[i, p]]
        assert ids[-1] == 50256 and c.decode(ids[:-1]) == (t or "").encode() and ids[:-1] == c.encode(t or "")


def test_packing_of_large_vocabularies(spark):
    row = packing.pack(docs(spark, ["a b", None]).coalesce(1), RANKS, P.PATTERN, length=8, end=70_000).first().asDict()
    assert len(row["ids"]) == 4 * 8 * row["n_rows"] and {tuple(ids) for _, _, ids in packing.unpack(row)} == {(64, 275, 70_000), (70_000,)}


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_the_plain_one(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 64) for _ in range(200)]
    where, n = packing.best_fit(sizes, 64)
    room = []
    for i in sorted(range(200), key=lambda i: -sizes[i]):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 64) - sizes[i])
    used = [0] * n
    for s, w in zip(sizes, where):
        used[w] += s
    assert sorted(64 - u for u in used) == sorted(room)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html><head><title>t</title></head><!-- c --><p>A &amp; B<br>c</p><script>x</script></html>"), (2, None, None)], "page_id long, url string, html string")
    resp = warc.responses(pages)
    rows = warc.derivatives(resp).collect()
    ids = {r.page_id: r.record_id for r in resp.collect()}
    conv = {r.page_id: r for r in rows if r.type == "conversion"}
    assert conv[1].block == "A & B\nc" and conv[2].block == "" and len(rows) == 4
    assert all(r.refers_to == ids[r.page_id] and f"WARC-Refers-To: {r.refers_to}\r\n" in r.record for r in rows)
    assert hashlib.sha256(conv[1].block.encode()).hexdigest() == conv[1].block_digest


def test_warc_keeps_headers(spark):
    html = '<html><head lang="en"><title>t</title></head ><body><header class="top"><h1>Headline</h1></header><p>x</p><HEADER>y</HEADER></body></html>'
    rows = warc.derivatives(warc.responses(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))).collect()
    assert [r.block for r in rows if r.type == "conversion"] == ["Headline\nx\ny"]


def text_of(spark, *pages):
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.block for r in warc.derivatives(warc.responses(df)).where("type = 'conversion'").orderBy("page_id").collect()]


def test_warc_references(spark):
    import html

    texts = ["&#8217;&copy;&mdash;&middot;", "a&nbsp;b &lt;p&gt; &amp;lt; &amp;amp;", "&#x1F600;&#128512;&#xE9;", "&eacute;&Eacute;&hearts;", "x &y; & z &", "&;&#;&#x;&#xZZ;&noname;", "&" * 50, "a&amp", "&#0;&#55296;&#1114112;&#x110000;", "&amp;#65;&#38;#65;"]
    want = [html.unescape(t).replace("\u00a0", " ").strip() for t in texts[:4]] + ["x &y; & z &", "&;&#;&#x;&#xZZ;&noname;", "&" * 50, "a&amp", "&#0;&#55296;&#1114112;&#x110000;", "&#65;&#65;"]
    assert text_of(spark, *texts) == want
    assert len(warc.NAMES) == 252


def test_warc_tags(spark):
    got = text_of(spark, "if 1 < 2 and 3 > 2 then<br/>x <3 y<!doctype html>z<?xml a?>", "a<!-- b <p>c", "a<script>b</style>c", "<p>a</p><style>b</style ><td>c</td><td>d</td><section\tid=1>e</section>", "<a href='x'>k</a>&<b>l</b>", "")
    assert got == ["if 1 < 2 and 3 > 2 then\nx <3 y z", "a", "a", "a\nc d\ne", "k & l", ""]


def test_warc_long_pages_and_repeated_rows(spark):
    import time

    began = time.time()
    long = ["<!-- a " * 200_000, "<script>" * 200_000, "<p>x</p>" * 100_000, "<" * 500_000, "&amp;" * 100_000]
    got = text_of(spark, *long)
    assert got == ["", "", "\n".join(["x"] * 100_000), "<" * 500_000, "&" * 100_000] and time.time() - began < 120
    twice = warc.digests(spark.createDataFrame([(1, "u", "x")] * 2 + [(None, None, None)], "page_id long, url string, html string").withColumn("Text", F.lit(1)).withColumn("record_id", F.lit(2))).collect()
    assert len(twice) == 6 and len(set(map(tuple, twice))) == 4
    assert warc.digests(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_files(spark, tmp_path):
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    rec = lambda kind, i, block: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Target-URI: http://{i}/\r\nWARC-Date: 2024-01-0{i}\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"
    (tmp_path / "a.warc").write_text(rec("warcinfo", 1, "x: y") + rec("response", 2, http + "<p>é\r\n\r\nb</p>\r\n") + rec("response", 3, http) + rec("response", 4, "no header"), newline="")
    got = warc.read_responses(spark, str(tmp_path / "a.warc")).orderBy("record_id").collect()
    assert [tuple(r) for r in got] == [("<urn:2>", "http://2/", "2024-01-02", http, "<p>é\r\n\r\nb</p>\r\n"), ("<urn:3>", "http://3/", "2024-01-03", http, ""), ("<urn:4>", "http://4/", "2024-01-04", "no header", "")]
    made = warc.derivatives(warc.read_responses(spark, str(tmp_path / "a.warc")).withColumn("page_id", F.lit(1).cast("long")))
    warc.write(made, str(tmp_path / "out"))
    again = spark.read.option("lineSep", "WARC/1.1\r\n").text(str(tmp_path / "out")).where("value <> ''")
    assert sorted("WARC/1.1\r\n" + r.value for r in again.collect()) == sorted(r.record for r in made.collect())


@pytest.mark.parametrize("run", [simhash.near_duplicates, simhash.similar, substring.dedup, mixing.mix, mixing.mixed, licenses.scan, lambda d: quality.rules(d, *VOCABULARIES), lambda d: bpe.digests(d, RANKS, P.PATTERN), lambda d: packing.pack(d, RANKS, P.PATTERN)])
def test_empty_and_null_tables(spark, run):
    assert run(docs(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None,) * 6] * 3 + [(1, None, None, None, None, None)] * 2, DOCS)
    run(nulls).collect()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [t for t in corpus() if t]
    docs(spark, texts).drop("body").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {r.doc_id for r in got} <= set(range(len(texts)))
    assert corpus_pipeline.near_dedup(spark, docs(spark, texts + [texts[0]]).drop("body"), "").where(f"doc_id = {len(texts)}").count() == 0
    good = quality.filtered(docs(spark, texts).drop("body"), *VOCABULARIES)
    kept = corpus_pipeline.near_dedup(spark, good, str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    new = {r.doc_id: r for r in corpus_pipeline.substring_dedup(spark, kept, str(tmp_path)).collect()}
    for d, (n, gone, sha) in brute_substring(rows).items():
        assert new[d].text == dict(rows)[d] if not gone else hashlib.sha256(new[d].text.encode()).hexdigest() == sha
        assert new[d].n_chars == len(new[d].text)


CLASHING = ["h", "H1", "fp", "shard", "rep", "rid", "comp", "copies", "k", "c", "s", "n", "digest", "canonical", "license", "node", "component", "size", "to", "f0", "low", "high", "copy", "kept", "label", "d", "tile", "part"]
WHOLE_TABLE = {
    "op1": simhash.near_duplicates, "similar": simhash.similar, "op3": licenses.scan, "op4": lambda d: packing.pack(d.coalesce(1), RANKS, P.PATTERN), "op6": lambda d: bpe.digests(d, RANKS, P.PATTERN),
    "op7": mixing.mix, "op8": substring.dedup, "op9": lambda d: quality.rules(d, *VOCABULARIES),
}


@pytest.mark.parametrize("name", WHOLE_TABLE)
def test_odd_tables(spark, name):
    """Nulls anywhere, long and empty texts, repeated rows, other columns of any name: the same result as without these columns, and repeated rows alike."""
    rng = random.Random(7)
    long = " ".join(rng.choices([f"w{i}" for i in range(5000)], k=100_000))
    rows = [(1, long, "en", "a"), (2, long + " more", "en", None), (3, None, None, "a"), (3, None, None, "a"), (None, "a b c", "de", "b"), (None, None, None, None), (4, "", "", ""), (5, "x" * 300_000, "fr", "b"), (6, CLEAN, "en", "a"), (6, CLEAN, "en", "a"), (6, CLEAN + "!", None, "a"), (7, " \n\t" * 1000, "xx", "c"), (8, licenses._MIT, "en", "c"), (8, licenses._MIT, "en", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    run = WHOLE_TABLE[name]
    plain = sorted(map(repr, run(df).collect()))
    assert sorted(map(repr, run(df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])).collect())) == plain
    assert run(df.limit(0)).count() == 0
    if name not in ("op4", "similar"):
        assert len(plain) == len(rows)
        seen = [p for p in plain if "doc_id=8" in p]
        assert len(seen) == 2 and (name == "op7" or len(set(seen)) == 1)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (None, [1.0, 0.0], 1), (None, None, None), (3, [0.0] * 5000 + [1.0], 2), (4, [0.0] * 5000 + [2.0], 2), (5, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(repr, embedding.near_duplicates(df).collect()))
    again = embedding.near_duplicates(df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING) if c != "label"])).collect()
    assert sorted(map(repr, again)) == got and len(got) == len(rows)
    by = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in again]
    assert by.count((1, 3, 1, True)) == 2 and (2, 3, 1, False) in by and (None, 3, 1, False) in by and (None, 0, None, False) in by and (5, 0, 5, True) in by and (4, 1, 3, False) in by
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_licenses_near_misses(spark, tmp_path):
    """Every known text is found whole, and not with a word changed, taken away or added: against a plain dictionary of digests."""
    known = {}
    plain = lambda t: spark.range(1).select(licenses.canonical(F.lit(t))).first()[0]
    forms = [r[0] for r in spark.createDataFrame([(t,) for _, t in licenses.KNOWN], "t string").select(licenses.canonical(F.col("t"))).collect()]
    for (name, _), form in zip(licenses.KNOWN, forms):
        known[form] = min(name, known.get(form, name))
    texts = []
    for _, t in licenses.KNOWN:
        words = t.split()
        mid = len(words) // 2
        texts += [t, t.swapcase(), "  " + t.replace("\n", "\r\n") + "\n\n", " ".join(words[:mid] + ["qzx"] + words[mid:]), " ".join(words[:mid] + words[mid + 1 :]), " ".join(words[:-1] + ["qzx"]), t + " qzx"]
    got = {r.doc_id: r.license for r in licenses.scan(docs(spark, texts)).collect()}
    canon = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.canonical(F.col("t"))).collect()]
    assert [got[i] for i in range(len(texts))] == [known.get(c) for c in canon]
    for i, (name, t) in enumerate(licenses.KNOWN):
        a = [got[7 * i + j] for j in range(7)]
        assert a[:3] == [known[forms[i]]] * 3 and a[3:] == [None] * 4, name
    system = Path("/usr/share/common-licenses")
    (tmp_path / "Own-2.0@short.txt").write_text("Do what\nyou like.")
    (tmp_path / "Own-2.0.txt").write_text("Do as you like, by Own 2.0.")
    (tmp_path / "Nothing.txt").write_text("!!!")
    got = licenses.scan(docs(spark, ["do what you LIKE", "Do as you like: by Own 2.0", "do", "..."]), licenses.folder(spark, str(tmp_path))).orderBy("doc_id").collect()
    assert [r.license for r in got] == ["Own-2.0", "Own-2.0", None, None]
    if (system / "Artistic").exists():
        text = (system / "Artistic").read_text()
        got = licenses.scan(docs(spark, [text, text + " x"]), [("Artistic", text)]).orderBy("doc_id").collect()
        assert [r.license for r in got] == ["Artistic", None]
    own = licenses.scan(docs(spark, ["My own licence, line\nby line."]), [("Own-1.0", "my own LICENSE line by line")]).first()
    assert own.license == "Own-1.0" and plain("a") == "a"
