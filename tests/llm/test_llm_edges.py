"""Defined results on odd and on empty tables."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from vantage.llm import chat, langid, mixing, ngram_join, packing, quality_crf, quality_rules, secrets, topk, toxicity
from vantage.llm.registry import QUERIES
from vantage.llm.shared import keep

ON_DOCUMENTS = [n for n in QUERIES if not n.startswith(("op8", "op10"))]


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_empty_tables_give_no_rows(name, spark, no_docs, labels, as_tables):
    assert QUERIES[name](spark, as_tables(no_docs, labels.limit(0))).count() == 0


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_odd_rows_get_a_row_each(name, spark, odd_docs, labels, as_tables):
    got = QUERIES[name](spark, as_tables(odd_docs, labels)).toPandas()
    if name.startswith("op2"):
        assert got.groupby(["sequence_id"])["length"].sum().max() <= packing.WINDOW
        got = got[got["start"] == 0]
    assert len(got) == 17
    assert got["doc_id"].isna().sum() == 2


def test_scores_stay_in_range(spark, odd_docs, labels, as_tables):
    at = as_tables(odd_docs, labels)
    for name in ("op1_toxicity", "op6_language_id", "op7_quality_crf"):
        low, high = QUERIES[name](spark, at).agg(F.min("score"), F.max("score")).first()
        assert 0 <= low <= high <= 1


def test_language_of_nothing_is_undefined(spark, odd_docs):
    got = langid.predict(odd_docs, langid.fit(odd_docs), True).toPandas().set_index("doc_id")
    assert {got.loc[k, "lang_pred"] for k in (4, 5, 6, 11)} == {"und"}
    assert got.loc[7, "lang_pred"] == "de" and got.loc[1, "lang_pred"] == "en"
    assert list(got.loc[4, "spans"]) == []
    kept = langid.keep_identified(odd_docs, langid.fit(odd_docs))
    assert kept.columns == odd_docs.columns and kept.count() == 17 - 5


def test_groups_of_odd_rows(odd_docs):
    got = {(r["doc_id"], r["component_id"], r["n_shingles"] > 0) for r in ngram_join.similar_groups(odd_docs).collect()}
    assert {(1, 1, True), (2, 1, True), (3, 1, True), (14, 1, True), (7, 7, True), (8, 7, True), (4, 4, False), (5, 5, False), (6, 6, False), (None, None, False)} <= got


def test_one_of_each_group_stays(odd_docs):
    left = ngram_join.first_of_groups(keep(odd_docs, "test"))
    assert left.columns == odd_docs.columns and left.count() == 17 - 5


def test_mix_takes_what_the_plan_says(odd_docs):
    sized = mixing.sizes(odd_docs)
    per, rates, ends = mixing.sampling(sized)
    plan = mixing.with_copies(sized, rates, ends).toPandas()
    assert plan["copies"].between(0, 3).all()
    assert abs(per.agg(F.sum("target")).first()[0] - plan["size"].sum()) < 1e-6
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == plan["copies"].sum()


def test_secrets_are_masked(odd_docs):
    ratios = secrets.train(odd_docs)
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(odd_docs, ratios).collect()}
    assert masked[13] == f'{secrets.MASK}" and {secrets.MASK} {secrets.MASK}, TOKEN:short'
    assert masked[4] is None and masked[1] == odd_docs.where("doc_id = 1").first()["text"]


def test_random_runs_are_told_from_words(spark):
    rows = [(k, "ordinary_identifier another-long-identifier some/path/of/words hyphenated-compound-word " * 3 + f"key: {'%016x' % (k * 0x9E3779B97F4A7C15 % 2**64)}") for k in range(200)]
    rows += [(900, "see qX7pZ9kLw2VbT4mRy8Jd and hyphenated-compound-word"), (901, "ordinary_identifier zzzzzzzzzzzzzzzzzzzzzzzz ----------------------")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs, secrets.train(docs)).select("doc_id", secrets.listed(F.col("spans")).alias("spans")).collect()}
    assert got[900] == "random:4:24" and got[901] == "" and got[5].startswith("hex:")


def test_cleaned_text_is_kept_with_all_columns(odd_docs):
    kept = quality_rules.clean(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} <= {1, 2, 3, 9, 13, 14, None}


def test_pieces_round_trip(odd_docs):
    from tokenizers import Tokenizer

    path = packing.default_path()
    own = Tokenizer.from_file(path)
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.where("doc_id IS NOT NULL").collect()}
    packed = packing.pack(keep(packing.pieces(odd_docs, path, with_ids=True), "test"), shard_rows=4)
    for r in packed.where("doc_id IS NOT NULL").collect():
        ids = [*own.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1][r["start"] : r["start"] + r["length"]]
        assert list(r["ids"]) == ids and r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    for s in packing.sequences(packed).collect():
        assert len(s["ids"]) <= packing.WINDOW and s["pieces"][0]["offset"] == 0


def test_best_fit_is_tightest(spark):
    assert packing.best_fit([70, 60, 40, 30], 100) == ([0, 1, 1, 0], [0, 0, 60, 70])
    lengths = sorted(((k * 7919) % 99 + 1 for k in range(500)), reverse=True)
    bins, offsets = packing.best_fit(lengths, 100)
    room: list[int] = []
    for n, b, o in zip(lengths, bins, offsets):
        fits = [r for r in room if r >= n]
        if b == len(room):
            assert not fits
            room.append(100)
        else:
            assert room[b] == min(fits)
        assert o == 100 - room[b]
        room[b] -= n


def test_units_give_the_same_ids():
    import random

    import numpy as np

    from vantage.llm.packing import tokenizer

    own = tokenizer(packing.default_path())
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "ß", "×", " ", "  ", "\n", "\t", " ", "　", ".", ",", "'s", "'", "7", "東", "|", "!!", "<|endoftext|>", " ", "à", "\x1c"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    flat, bounds = own.encode(data, offsets)
    for k, text in enumerate(texts):
        assert flat[bounds[k] : bounds[k + 1]].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "ok"), (1, 3, "assistant", "well"), (2, 0, None, None), (2, 0, None, None), (3, 0, None, None), (5, None, "user", "alone"), (None, 1, "user", "lost")]
    turns += [(c, t, "user", f"t{t}" + "!" * (c == 7 and t == 300)) for c in (6, 7) for t in range(600)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit("x"), "a.b": F.lit("x")})
    got = {(r["pair_id"], r["chunk"]): r for r in chat.preferences(df).collect()}
    one = got[0, 0]
    assert (one["n_prompt"], one["prompt"], one["chosen"]) == (1, "<|user|>\nhi\n", "<|assistant|>\nyes\n")
    assert one["rejected"] == "<|assistant|>\nno\n<|user|>\nok\n<|assistant|>\nwell\n"
    assert [tuple(s) for s in one["chosen_spans"]] == [(0, 18)] and [one["rejected"][a:b] for a, b in one["rejected_spans"]] == ["<|assistant|>\nno\n", "<|assistant|>\nwell\n"]
    assert (got[1, 0]["n_prompt"], got[1, 0]["chosen"], got[1, 0]["rejected"]) == (1, "<||>\n\n", "")
    assert (got[2, None]["n_prompt"], got[2, None]["chosen"], got[2, None]["rejected"]) == (0, "", "<|user|>\nalone\n")
    assert [(got[3, c]["n_prompt"], got[3, c]["n_chosen"], got[3, c]["n_rejected"]) for c in (0, 1, 2)] == [(256, 0, 0), (44, 212, 212), (0, 88, 88)]
    assert len(got) == 6 and chat.preferences(df.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [((k * 37 + j * 11) % 17 - 8) / 8.0 for j in range(5)]) for k in range(60)] + [(61, None), (62, [None, 1.0]), (63, [nan]), (64, [inf, 0.0]), (65, []), (66, [1.0]), (80, [1e14, 2.0]), (82, [-9.0, 5.0]), (60, [0.5] * 5), (60, [0.5] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    vectors = topk.whole_vectors(df)
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 7).collect()
    import math

    own = [(i, [math.floor(64 * x) for x in v] + [0] * (5 - len(v))) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for a, (i, q) in enumerate(own):
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(own) if a != b)[:7]
            expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert topk.top_k(vectors.limit(0), vectors.limit(0), 3).count() == 0


def test_weights_catch_one_word_in_a_long_text(spark):
    rows = [(k, ("calm river stones under trees " * 40) + ("vileword " if k % 2 else "") + "calm river " * 40, k % 2) for k in range(300)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows if a < 200], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, *toxicity.fit(docs, labels)).collect()}
    assert all((got[k] >= 0.5) == bool(k % 2) for k in got)


def test_chain_sums_match_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    unary, pair = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    first = np.array([0, 3, 5])
    line, bases = quality_crf.side_by_side(first)
    marginal = np.empty((5, 2))
    marginal[line] = quality_crf.chain_sums(unary[line], pair, bases)[0]
    for a, b in zip(first, first[1:]):
        total = np.zeros((b - a, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(unary[a + k, s] for k, s in enumerate(y)) + sum(pair[y[k], y[k + 1]] for k in range(b - a - 1)))
            for k, s in enumerate(y):
                total[k, s] += w
        assert np.allclose(marginal[a:b], total / total.sum(1, keepdims=True))


def test_viterbi_matches_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    firsts = np.array([0, 4, 4, 9])
    scores = (rng.normal(size=(9, 3)) * 5).astype(np.float32)
    got = langid.viterbi(scores, firsts, 3.0)
    for a, b in zip(firsts, firsts[1:]):
        worth = lambda y: sum(scores[a + k, s] for k, s in enumerate(y)) - 3.0 * sum(p != q for p, q in zip(y, y[1:]))
        if b > a:
            assert worth(got[a:b]) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=b - a))), abs=1e-4)


def test_similar_sets_share_a_signature():
    """Whatever the frequency levels are, and small and large sets alike."""
    import numpy as np

    rng = np.random.default_rng(7)
    for trial in range(300):
        n = int(rng.integers(1, 160))
        pool = rng.integers(0, 2**63, n + 60, dtype=np.uint64)
        level_of = {int(t): int(v) for t, v in zip(pool, rng.integers(0, 9, len(pool)) * (trial % 3) * (rng.random(len(pool)) < 0.9))}
        x = np.unique(pool[:n])
        swap = int(rng.integers(0, max(1, n // 4)))
        y = np.unique(np.concatenate((pool[swap:n], pool[n : n + int(rng.integers(0, swap + 1))])))
        both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if 100 * both < 80 * union:
            continue
        if len(x) < 4 and len(x) == len(y) and both == len(x):
            continue  # equal sets are one class
        (a, pa_), (b, pb_) = (ngram_join.signatures(s, np.array([level_of[int(t)] for t in s], np.uint8)) for s in (x, y))
        common, ia, ib = np.intersect1d(a, b, return_indices=True)
        room = [180 * min(len(x) - pa_[i], len(y) - pb_[j]) >= 80 * (len(x) + len(y)) for i, j in zip(ia, ib)]
        assert any(room), (n, swap)
        assert ngram_join.may_share(ngram_join.bucket_counts(x), ngram_join.bucket_counts(y), len(x), len(y))


def test_toxic_share_of_a_bounded_sample(spark, monkeypatch):
    """A word that all toxic and 40 % of the other texts hold, at 10 % toxic: a chance of 0.22, whatever part of the labels is taken."""
    rng = random.Random(8)
    rows = [(k, k % 10 == 0, " ".join(rng.choice("calm river stone under tree field".split()) for _ in range(12))) for k in range(2000)]
    docs = spark.createDataFrame([(k, t + " vileword" * (y or k % 5 in (1, 3))) for k, y, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, y, _ in rows], "doc_id long, toxic int")
    scores = []
    for most in (2000, 100):
        monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", most)
        monkeypatch.setattr(toxicity, "SAMPLE_OTHER", most)
        got = [r["score"] for r in toxicity.score(docs, *toxicity.fit(docs, labels)).collect()]
        assert max(got) < 0.5
        scores.append(sum(got) / len(got))
    assert abs(scores[0] - scores[1]) < 0.03


@pytest.fixture
def split_files(spark):
    """Sets into how many parts files are read at least; more parts give their rows other numbers."""
    name = "spark.sql.files.minPartitionNum"
    yield lambda n: spark.conf.set(name, str(n))
    spark.conf.unset(name)


def test_firsts_of_groups_when_files_are_split_otherwise(spark, monkeypatch, split_files, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10000)}" for _ in range(40)) for _ in range(20)]
    spark.createDataFrame([(k, texts[k % 20]) for k in range(80)], "doc_id long, text string").repartition(4, "doc_id").write.parquet(f"{tmp_path}/docs")
    groups = ngram_join.similar_groups

    def then_split(docs):
        found = keep(groups(docs), "test-groups")
        split_files(8)
        return found

    monkeypatch.setattr(ngram_join, "similar_groups", then_split)
    split_files(1)
    got = [r["text"] for r in ngram_join.first_of_groups(spark.read.parquet(f"{tmp_path}/docs")).collect()]
    assert sorted(got) == sorted(texts)


def test_vectors_keep_their_numbers_when_files_are_split_otherwise(spark, split_files):
    split_files(8)
    rows = spark.createDataFrame([(k, [float(k)]) for k in range(40)], "vec_id long, embedding array<double>").repartition(4, "vec_id")
    vectors = topk.whole_vectors(rows)
    seen = []
    for n in (1, 8):
        split_files(n)
        seen.append({r["vec_id"]: r["rid"] for r in vectors.select("rid", "vec_id").collect()})
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 40


def test_all_telling_ngrams_are_kept(spark):
    rng = random.Random(10)
    own = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(700)]
    rows = [(k, k % 2, " ".join(own) if k % 2 else "calm river stones") for k in range(120)]
    docs = spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, text string")
    table, _ = toxicity.fit(docs, spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, toxic int"))
    assert (table != 0).sum() > 10000


def sets_of_edits(n_texts: int, edits: int, words: int, seed: int) -> list[str]:
    """Edits of one base: some words changed, from none to so many."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    texts = []
    for k in range(n_texts):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = rng.choice(("x", "y", f"v{k}", f"v{rng.randrange(9)}"))
        texts.append(" ".join(own))
    return texts


def test_a_large_group_of_edits(spark, monkeypatch):
    """As by brute force over all pairs, and with few pairs looked at."""
    texts = sets_of_edits(1500, 9, 90, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    looked = []
    orig = ngram_join.possible
    monkeypatch.setattr(ngram_join, "possible", lambda pairs, listed: (looked.append(pairs.count()), orig(pairs, listed))[1])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(docs).collect()}
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) > 300 and links > 40000
    assert sum(looked) < 60000  # of 1.1 million pairs


def test_scores_beyond_64_bits_are_an_error(spark):
    for rows in ([(20, [1e16]), (21, [1e16])], [(20, [1e300]), (21, [1.0])]):
        with pytest.raises(Exception, match="64 bits"):
            vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
            topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 3).count()


def test_annuli_are_pruned(spark, monkeypatch):
    """On clustered vectors a query is held against a small part of all."""
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 16))).tolist()
    vectors = topk.whole_vectors(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>"))
    scored = []
    kept = topk.keep

    def seen(df, tag):
        out = kept(df, tag)
        if tag == "query-asks":
            scored.append(out.select("cell", (F.length("q_rids") / 8).alias("n")).groupBy("cell").agg(F.sum("n").alias("n")))
        if tag == "vector-blocks":
            seen.blocks = out.select("cell", (F.length("rids") / 8).alias("rows")).groupBy("cell").agg(F.sum("rows").alias("rows"))
        return out

    monkeypatch.setattr(topk, "keep", seen)
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 5).collect()
    pairs = sum(s.join(seen.blocks, "cell").agg(F.sum(F.col("n") * F.col("rows"))).first()[0] or 0 for s in scored)
    assert pairs < 0.5 * 200 * 4000
    v = np.floor(64 * np.array(x)).astype(np.int64)
    s = v[::20] @ v.T
    expected = set()
    for q in range(200):
        best = sorted((-int(s[q, j]), j) for j in range(4000) if j != 20 * q)[:5]
        expected |= {(20 * q, k + 1, j, -w) for k, (w, j) in enumerate(best)}
    assert {tuple(r) for r in got} == expected


def test_texts_without_a_letter_have_no_language(spark):
    docs = spark.createDataFrame([(k, "der fluss und die wiese", "de") for k in range(20)] + [(90, "\u0301 12 \u0308", None), (91, "\u00b2 34 \u20ac", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got[90] == got[91] == ("und", 0.0) and got[0][0] == "de"


def test_a_text_of_four_languages_stays(spark):
    words = {"en": "the river and the meadow with the stones of the valley", "de": "der fluss und die wiese mit den steinen aus dem tal", "fr": "la riviere et le pre avec les pierres de la vallee", "es": "el rio y la pradera con las piedras del valle hermoso"}
    docs = spark.createDataFrame([(k, " ".join([w] * 5), lang) for k, (lang, w) in enumerate(words.items())] * 10 + [(99, " ".join(" ".join([w] * 4) for w in words.values()), None)], "doc_id long, text string, lang string")
    assert langid.keep_identified(docs, langid.fit(docs)).where("doc_id = 99").count() == 1


def test_long_texts_are_cut_without_a_change(spark, monkeypatch):
    """Word hashes, ids and counts of a text that goes through many parts equal those of one that doesn't."""
    import numpy as np
    from tokenizers import Tokenizer

    from vantage.llm import batches

    rng = random.Random(4)
    text = "".join(rng.choice(["stone ", "river, ", "\u00fc\u00df ", "<|endoftext|>", "\u6771", "x" * 300, "\n\n", "7 "]) for _ in range(4000))
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = batches.words_of(data, np.array([0, len(data)]))
    assert (batches.word_hashes(data, starts, ends, 1000) == batches.word_hashes(data, starts, ends)).all()
    own = packing.tokenizer(packing.default_path())
    parts = list(own.parts(data, 2000))
    assert len(parts) > 20 and b"".join(p.tobytes() for p in parts) == text.encode()
    ids = np.concatenate([own.encode(p, np.array([0, len(p)]))[0] for p in parts])
    assert ids.tolist() == Tokenizer.from_file(packing.default_path()).encode(text, add_special_tokens=False).ids
    import pyarrow as pa

    rows, seen = [], b""
    for owner, part, offsets in batches.text_parts(pa.array(["a b", text, None, "c"]), 5000, 1000):
        rows += owner.tolist()
        seen += part.tobytes()
        assert np.diff(offsets).max() <= 1000
        for a in offsets[:-1]:
            part[a:].tobytes()[:4].decode("utf-8", "ignore")
    assert seen == ("a b" + text + "c").encode() and rows == sorted(rows) and set(rows) == {0, 1, 2, 3}


def test_inclusion_differs_within_a_source(spark):
    """Certain copies and chances follow the size class, and the words taken come near the target."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, "w " * rng.choice((20, 100, 400, 2000)), f"s{k % 5}") for k in range(3000)], "doc_id long, text string, source string")
    sized = mixing.sizes(docs)
    per, rates, ends = mixing.sampling(sized)
    got = mixing.with_copies(sized, rates, ends).toPandas()
    got["weight"] = got["size"].map({20: 1, 100: 2, 400: 4, 2000: 3})
    mean = got.groupby(["source", "weight"])["copies"].mean().unstack()
    assert (mean[4] > mean[2] + 0.05).sum() >= 3 and got["copies"].max() <= 3
    taken = (got["copies"] * got["size"]).groupby(got["source"]).sum()
    for r in per.collect():
        assert abs(taken[r["source"]] - r["target"]) <= 1000


def test_gradient_is_that_of_the_likelihood():
    """Of all four pairs and the lines' weights, against differences; and the likelihood against enumeration."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    first = np.array([0, 4, 5, 9])
    x, label = rng.normal(size=(9, 3)), rng.integers(0, 2, 9)
    rate_of = np.array([0.5, 1.5, 0.7])
    line, bases = quality_crf.side_by_side(first)
    rate = np.repeat(rate_of, np.diff(first))
    theta = rng.normal(size=7)

    def enumerated(theta):
        total = 0.0
        for k, (a, b) in enumerate(zip(first, first[1:])):
            pair = theta[3:].reshape(2, 2)
            worth = lambda y: sum(y[i] * (x[a + i] @ theta[:3]) for i in range(b - a)) + sum(pair[p, q] for p, q in zip(y, y[1:]))  # noqa: B023, E731
            total += rate_of[k] * (np.log(sum(np.exp(worth(y)) for y in itertools.product((0, 1), repeat=b - a))) - worth(tuple(label[a:b])))
        return total

    value, grad = quality_crf.loss(theta, x[line], label[line], rate[line], bases)
    assert value == pytest.approx(enumerated(theta))
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-6
        assert grad[k] == pytest.approx((enumerated(theta + step) - enumerated(theta - step)) / 2e-6, abs=1e-5)


def test_bad_lines_are_told_from_good_ones(spark, monkeypatch):
    monkeypatch.setattr(quality_crf, "RELABELS", 1)
    rng = random.Random(14)
    good = lambda: " ".join(rng.choice("calm river old trees people walk along evening meadow stone".split()) for _ in range(rng.randrange(7, 16))).capitalize() + "."
    bad = lambda: "CLICK!! | $$$ #### {menu} >>> " + str(rng.randrange(10**6)) + " !!!!"
    rows = [(k, "\n".join(good() if k % 2 or j in (0, 1, 5) else bad() for j in range(8)), k % 2) for k in range(160)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    chain = quality_crf.fit(docs, spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, quality int"))
    got = {r["doc_id"]: [x["good"] for x in r["lines"]] for r in quality_crf.label_lines(docs, chain).collect()}
    right = sum(x == (k % 2 == 1 or j in (0, 1, 5)) for k, lines in got.items() for j, x in enumerate(lines))
    assert right >= 0.95 * 160 * 8 and sum(got[0]) < 8


def test_characters_outside_ascii_are_one_each():
    import numpy as np

    from vantage.llm import batches

    for text in ("\u00dcber \u6771\u4eac \U0001f600!", "plain", ""):
        code, starts = batches.code_points(np.frombuffer(text.encode(), np.uint8))
        assert code.tolist() == [ord(c) for c in text] and len(starts) == len(text)
    upper, lower = (toxicity.present(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), None)[1].tolist() for t in ("\u00dcBER \u00c4RGER", "\u00fcber \u00e4rger"))
    assert upper == lower and len(lower) == sum(len("\u00fcber \u00e4rger") - n + 1 for n in toxicity.GRAMS)


def test_a_long_text_has_the_features_of_its_whole(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    texts = ["short one", "".join(rng.choice("abcdefgh\u00e4\u6771 ") for _ in range(30000)), None, "another", "".join(rng.choice("xyz \u00f6") for _ in range(9000)), "end of it"]
    whole = {(k, b) for k, t in enumerate(texts) if t for b in toxicity.present(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), None)[1].tolist()}
    monkeypatch.setattr(toxicity, "SLICE", 4000)
    pairs = [(int(r), int(b)) for row, bucket in toxicity.features_of(pa.array(texts), None) for r, b in zip(row, bucket)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == whole


def test_random_runs_by_brute_force(spark):
    """Spans of the chains as plain loops find them; and how many made-up secrets they catch, at what price."""
    import re

    rng = random.Random(13)
    word = lambda: "-".join(rng.choice("river stone window meadow harbour station garden northern valley bridge".split()) for _ in range(rng.randrange(2, 4)))
    secret = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randrange(20, 40)))
    rows, truth = [], set()
    for k in range(300):
        parts = [word() for _ in range(5)]
        if k % 3 == 0:
            parts.insert(2, secret())
            truth.add((k, parts[2]))
        rows.append((k, " ".join(parts) + (f" key: {rng.getrandbits(64):016x}" if k % 2 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratios = secrets.train(docs)
    got = {(r["doc_id"], s["start"], s["end"]) for r in secrets.scan(docs, ratios).collect() for s in r["spans"] if s["kind"] == 3}
    texts, size, expected = dict(rows), len(secrets.ALPHABET), set()
    for k, text in rows:
        base = [m.span() for m in re.finditer(secrets.HEX, text)]
        for m in re.finditer(secrets.TOKEN, text):
            at = [secrets.ALPHABET.index(c) for c in m[0]]
            if len(set(at)) >= secrets.MIN_DISTINCT and sum(ratios[a * size + b] for a, b in zip(at, at[1:])) >= secrets.MIN_RATIO and not any(a < m.end() and m.start() < b for a, b in base):
                expected.add((k, *m.span()))
    assert got == expected
    caught = {(k, texts[k][a:b]) for k, a, b in got}
    assert len(caught & truth) >= 0.9 * len(truth) and len(caught - truth) <= 0.05 * len(caught)


def test_names_with_dots_are_kept(odd_docs, spark):
    docs = odd_docs.withColumns({"a.b": F.lit(1), "c`d": F.lit("x")})
    assert mixing.mix(docs).columns == docs.columns
    assert quality_rules.clean(docs).columns == docs.columns
    assert secrets.redact(docs, [0.0] * len(secrets.ALPHABET) ** 2).columns == docs.columns
    assert ngram_join.first_of_groups(docs).columns == docs.columns
