"""The queries on the smallest tables: against their SQL, brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import same

import corpus_pipeline
from vantage.llm import langid, packing
from vantage.llm.registry import ORACLES, QUERIES
from vantage.llm.shared import documents, keep

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def texts_of(spark, sf_dir) -> dict[int, str]:
    return {r["doc_id"]: r["text"] or "" for r in documents(spark, sf_dir).select("doc_id", "text").collect()}


def groups_by_brute_force(texts: dict[int, str]) -> tuple[dict, dict]:
    """(component, number of shingles) of each document, by counting shared shingles of all pairs that share any."""
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    holders, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name])


def test_groups(spark, sf_dir):
    component, size = groups_by_brute_force(texts_of(spark, sf_dir))
    for r in QUERIES["op3_ngram_join"](spark, sf_dir).collect():
        assert (r["n_shingles"], r["component_id"]) == (size[r["doc_id"]], component[r["doc_id"]])


def test_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_path())
    ids = {i: [*own.encode(t, add_special_tokens=False).ids, 1] for i, t in texts_of(spark, sf_dir).items()}
    covered, used = Counter(), defaultdict(list)
    for r in QUERIES["op2_best_fit_packing"](spark, sf_dir).collect():
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
        covered.update((r["doc_id"], r["start"] + k) for k in range(r["length"]))
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(covered) == sum(map(len, ids.values())) and set(covered.values()) == {1}
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert sum(map(len, ids.values())) > 0.98 * packing.WINDOW * len(used)


def test_secret_spans(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    for r in QUERIES["op9_secret_scan"](spark, sf_dir).collect():
        text = texts[r["doc_id"]]
        found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        found.sort(key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))
        listed = [f"{k}:{a}:{b}" for a, k, b in found]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] == listed
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == s[1] for s in found) for k in ("assign", "access", "hex"))


def test_held_out_languages(spark):
    at = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in documents(spark, at).collect()}
    rows = [r for r in QUERIES["op6_language_id"](spark, at).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.98 * len(rows)


@pytest.mark.parametrize(("name", "column", "least"), [("op1_toxicity", "toxic", 0.85), ("op7_quality_crf", "quality", 0.95)])
def test_held_out_labels(spark, name, column, least):
    at = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in QUERIES[name](spark, at).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    good = [r["score"] for r in rows if truth[r["doc_id"]] == 1]
    bad = [r["score"] for r in rows if truth[r["doc_id"]] == 0]
    assert all(r["predicted"] == int(r["score"] >= (0.5 if column == "toxic" else 0.3)) for r in rows)
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= least * len(good) * len(bad)


def test_pipeline_by_stages(spark, sf_dir):
    """Each stage against brute force on what the one before it kept."""
    docs = documents(spark, sf_dir)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = keep(stage(spark, docs, sf_dir), f"test-{name}")
        seen[name] = docs
        if name == "language_id":
            kept = {r["doc_id"] for r in docs.collect()}
            assert all(i in kept for i, t in texts_of(spark, sf_dir).items() if len(t) > 200)
        if name == "ngram_jaccard_join":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            component, _ = groups_by_brute_force(texts)
            assert Counter(component[r["doc_id"]] for r in docs.collect()) == Counter(set(component.values()))
        if name == "secret_scan":
            assert docs.count() == before.count()
            assert not [r for r in docs.collect() if re.search("[0-9a-f]{16,}", r["text"])]
        if name == "source_mix":
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
        if name != "packing":
            assert docs.columns == columns
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in seen["secret_scan"].collect()}
    taken = sum(words[r["doc_id"]] for r in seen["source_mix"].select("doc_id").collect())
    assert abs(taken - sum(words.values())) < 0.1 * sum(words.values())
    pieces = seen["packing"].where("start = 0").count()
    assert pieces == seen["source_mix"].count()


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, rows):
    docs = keep(odd_docs if rows == "odd" else no_docs, "test")
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, ""), "test")
    assert (docs.count() > 0) == (rows == "odd")


def test_spans_switch_with_the_language(spark):
    en, de = "the river and the meadow with the stones of the valley ", "der fluss und die wiese mit den steinen aus dem tal "
    rows = [(k, (en if k % 2 else de) * 6, "en" if k % 2 else "de") for k in range(40)] + [(99, en * 4 + de * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.fit(docs), True).where("doc_id = 99").first()
    assert [(s["lang"], s["start"], s["end"]) for s in got["spans"]] == [("en", 0, 44), ("de", 44, 77)]
