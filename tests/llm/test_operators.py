"""The training-data operators against brute force, SQL and awkward rows."""

from __future__ import annotations

import hashlib
import html
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import same
from pyspark.sql import functions as F

from chunkloom.llm import _common, _grams, exact_dedup, html_extraction, language_id, mixing, nearest, ngram_join, packing, pii, quality, queries, substring_dedup
from chunkloom.llm._common import placed, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, size int, chunk int, label int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 300)
    texts = [None, "", "  \n\t ", "one", "one two three four", "One  TWO\tthree four", base, base, base.upper(), base + " tail", "x" * 30_000, prose(rng, 20_000), "+++ 123 !!!", "émile çà va bien"]
    for k in range(12):
        words = base.split()
        words[k * 20 % 300] = f"changed{k}"
        texts.append(" ".join(words))
    texts += [prose(rng, rng.randrange(1, 400)) for _ in range(30)]
    langs = ["en", "fr", None, "de"]
    rows = [(k, t, langs[k % 4], None if k % 6 == 0 else f"src{k % 5}", None, "id", 1, 2, 3, None) for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], (6, "another text of row six", "en", None, 1, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def with_null_id(spark, docs):
    return docs.unionByName(spark.createDataFrame([(None, "a text without an id", None, None, None, None, None, None, None, None)] * 2, SCHEMA))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(name, spark, duck, sf_dir):
    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df())


# ---------------------------------------------------------------- 8


def test_exact_dedup(spark, docs, awkward, nothing, monkeypatch):
    groups = defaultdict(list)
    for r in awkward:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.exact_groups(docs).collect()
    assert Counter(r["id"] for r in got) == Counter(r[0] for r in awkward)
    for r in got:
        (text,) = [t for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["sha256"]]
        assert r["keep_id"] == max(groups[text]) and r["group_size"] == len(groups[text])
    kept = Counter(r["sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in out.collect()) == Counter((max(ids), t) for t, ids in groups.items())
    assert exact_dedup.exact_groups(nothing).count() == exact_dedup.exact_dedup(nothing).count() == 0
    assert exact_dedup.exact_dedup(with_null_id(spark, docs)).where("doc_id is null").count() == 1
    # rows of files, where survivors and losers are too many to be told to every task
    monkeypatch.setattr(_common, "TOLD_ROWS", 0)
    stored = written(docs, "t-exact")
    assert sorted(map(str, exact_dedup.exact_dedup(stored).collect())) == sorted(map(str, out.collect()))
    plan = exact_dedup.exact_dedup(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "placed" not in plan


def test_places_are_only_those_of_plain_rows_of_files(spark, docs):
    stored = written(docs.select("doc_id", "text"), "t-places")
    assert placed(stored).select("file", "at").distinct().count() == stored.count()
    twice = stored.join(spark.range(2).withColumnRenamed("id", "time"), how="cross")
    assert placed(twice).select("file", "at").distinct().count() == 2 * stored.count()


# ---------------------------------------------------------------- 3


def test_mixing(spark, docs, awkward, nothing):
    got = mixing.mixed(docs).toPandas()
    sizes = Counter()
    for r in awkward:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert len(got) == len(awkward) and (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    # water filling, step by step
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, open_ = 1.5 * sum(sizes.values()), set(order)
    target = {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else weight[s] * level
            budget -= target[s]
        open_ -= full or open_
    for s in order:
        part = got[got["src"].isna()] if s is None else got[got["src"] == s]
        assert part["source_size"].iloc[0] == sizes[s]
        assert part["target"].iloc[0] == pytest.approx(target[s])
        assert abs(part["taken"].sum() - target[s]) <= 0.01 * target[s] + 2
    again = mixing.mixed(docs.repartition(5)).toPandas()
    key = ["id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert mixing.mixed(nothing).count() == 0
    assert mixing.mixed(docs.where("coalesce(text, '') = ''")).agg(F.sum("taken")).first()[0] == 0


def test_mixing_serves_a_rare_source_of_a_large_corpus(spark):
    big = spark.range(1500).selectExpr("id AS doc_id", "repeat('a ', 4000) AS text", "'big' AS source")
    rare = spark.createDataFrame([(2000, "b " * 300, None), (2001, "c " * 150, "rare"), (2002, "d", "tiny"), (2003, "", "empty")], "doc_id long, text string, source string")
    got = {r["src"]: r for r in mixing.mixed(big.unionByName(rare)).groupBy("src").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert [got[s]["target"] for s in (None, "rare", "tiny", "empty")] == [600, 300, 2, 0]
    assert all(abs(r["taken"] - r["target"]) <= 0.005 * r["target"] + 1 for r in got.values()), got


def test_apportionment(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(12):
        votes, seats = [rng.choice([0.0, rng.random() * 10, rng.random() * 1e6, 5.0]) for _ in range(rng.randrange(1, 30))], rng.randrange(0, 500)
        won = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            best = max(range(len(votes)), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))
            won[best] += 1
        rows += [(g, k, v, seats) for k, v in enumerate(votes)]
        want |= {(g, k): w for k, w in enumerate(won)}
    got = mixing.apportion(spark.createDataFrame(rows, "g int, k int, votes double, seats long"), ["g"], ["k"], "votes", "seats").collect()
    assert {(r["g"], r["k"]): r["won"] for r in got} == want


# ---------------------------------------------------------------- 2


def test_packing(spark, docs, awkward, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = packing.packed(docs, path).toPandas()
    want = Counter()
    for doc_id, text, *_ in awkward:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(got[["id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    got = got.sort_values(["sequence_id", "offset"])
    ends = got["offset"] + got["length"]
    assert ends.max() <= 2048
    assert (got["offset"] == ends.groupby(got["sequence_id"]).shift(fill_value=0)).all()
    assert got["sequence_id"].nunique() == packing.lower_bound(Counter(got["length"].tolist()), 2048)
    assert packing.packed(nothing, path).count() == 0


def test_word_tokens_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, words = Tokenizer.from_file(path), packing.WordTokens(path, remembered=50)
    assert words.by_word
    rng = random.Random(9)
    pieces = ["don't", "I'll", "x.y", "Straße!", "ÉTÉ,", "áb", "ΣΑΣ", "中文", "12ab34", "<|endoftext|>", "<|startoftext|>Word", "word<|endoftext|>", "''s", "(a)", "\x01", "a b", "é'ré", "ﬁne", "İx", "🙂", "-", "Œuvre..."]
    for _ in range(300):
        text = "".join(rng.choice([*pieces, prose(rng, 2)]) + rng.choice([" ", "\n", "\t ", " ", ""]) for _ in range(rng.randrange(8)))
        assert words.ids(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_other_tokenizer_files_tokenise_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, words = Tokenizer.from_file(path), packing.WordTokens(path)
    assert not words.by_word
    for text in ("Two  words,\n\tand É<|endoftext|> more.", "", " a "):
        assert words.ids(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_crossover_beats_greedy():
    """Bins that can be filled exactly, by three pieces each, which greedy filling misses."""
    rng, better, lost = random.Random(4), 0, 0
    for k in range(12):
        counts: Counter = Counter()
        for _ in range(20):
            a = rng.randrange(300, 450)
            b = rng.randrange(270, 1000 - a - 260)
            counts.update((a, b, 1000 - a - b))
        greedy = sum(packing.best_fit(counts, 1000).values())
        found = packing.fitness(packing.evolve([], counts, 1000, 150, 8, k)[0], 1000)[0]
        assert packing.lower_bound(counts, 1000) <= found <= greedy
        better += found < greedy
        lost += greedy > packing.lower_bound(counts, 1000)
    assert lost >= 6 and better >= lost // 2, (lost, better)


def test_packing_search_improves_and_keeps_all():
    rng = random.Random(2)
    for _ in range(20):
        counts = Counter(rng.randrange(1, 101) for _ in range(rng.randrange(1, 400)))
        grown = packing.evolve([], counts, 100, 20, 5, rng.randrange(99))
        for solution in grown:
            held = Counter()
            for pattern, n in solution.items():
                assert sum(pattern) <= 100 and n > 0
                for x in pattern:
                    held[x] += n
            assert held == counts
        best = packing.fitness(grown[0], 100)[0]
        assert packing.lower_bound(counts, 100) <= best <= sum(packing.best_fit(counts, 100).values())
    # best fit takes 3 bins here; whole bins of two parents make 2
    assert packing.fitness(packing.evolve([], Counter({6: 1, 5: 2, 4: 1}), 10, 40, 6, 1)[0], 10)[0] == 2


# ---------------------------------------------------------------- 6


def shingle_sets(rows):
    out = []
    for doc_id, text, *_ in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
        out.append((doc_id, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    return out


def components_of(sets):
    ids = [d for d, _ in sets]
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {d: find(d) for d in ids}


def test_ngram_join(spark, docs, awkward, nothing):
    sets = shingle_sets(awkward)
    want = components_of(sets)
    got = ngram_join.similarity_classes(docs).collect()
    assert {r["id"]: r["component"] for r in got} == want
    assert Counter((r["id"], r["n"]) for r in got) == Counter((d, len(s)) for d, s in sets)
    assert ngram_join.similarity_classes(nothing).count() == 0
    lone = ngram_join.similarity_classes(with_null_id(spark, docs)).where("id is null").collect()
    assert [r["component"] for r in lone] == [None, None]


def test_ngram_join_links_all_texts_of_an_id(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 60, 5000) for _ in range(3))
    rows = [(5, a), (5, b), (2, a + " one"), (3, b + " one"), (7, c), (7, c), (8, b + " two"), (9, "alone")]
    for part in (rows, rows[::-1]):
        got = ngram_join.similarity_classes(spark.createDataFrame(part, "doc_id long, text string").repartition(3)).collect()
        assert {r["id"]: r["component"] for r in got} == {5: 2, 2: 2, 3: 2, 8: 2, 7: 7, 9: 9}


@pytest.mark.parametrize("kind", ["clustered", "long region", "one id", "no id"])
def test_chunks_are_bounded_by_bytes(spark, kind):
    target = 20_000
    n = spark.range(0, 4000, 1, 8).select(F.col("id").alias("k"), F.monotonically_increasing_id().alias("far"))
    text = F.repeat(F.concat(F.col("k").cast("string"), F.lit(" ")), F.when((F.col("k") > 3000) & F.lit(kind == "long region"), 300).otherwise(8))
    doc_id = {"clustered": F.col("far"), "long region": F.col("k"), "one id": F.when(F.col("k") % 3 == 0, F.lit(7)).otherwise(F.col("k")), "no id": F.when(F.col("k") % 3 > 0, F.col("k"))}[kind]
    rows, chunks, _ = _grams.chunked(n.select(doc_id.cast("long").alias("doc_id"), text.alias("text")), "doc_id", "text", target)
    got = rows.groupBy("chunk").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("chunk").collect()
    assert max(r["bytes"] for r in got) <= (1.5 if kind in ("one id", "no id") else 1.0) * target
    assert len(got) < 2 * chunks + 8
    for x, y in zip(got, got[1:], strict=False):
        if y["lo"] is not None and x["chunk"] >> _grams.PART_OF_ID != y["chunk"] >> _grams.PART_OF_ID:
            assert x["hi"] < y["lo"]
    assert rows.count() == 4000


def test_ngram_join_families(spark):
    """Families whose members are on either side of the threshold: no link may be lost."""
    rng = random.Random(8)
    rows = []
    for family in range(4):
        base = [f"f{family}w{rng.randrange(900)}" for _ in range(120)]
        for _ in range(45):
            words = list(base)
            for _ in range(rng.randrange(0, 7)):
                words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words = words[: rng.randrange(80, 120)]
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    got = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = components_of(shingle_sets(rows))
    assert {r["id"]: r["component"] for r in got} == want
    assert 4 < len(set(want.values())) < len(rows)


# ---------------------------------------------------------------- 9


def test_substring_dedup(spark, nothing, monkeypatch):
    rng = random.Random(4)
    passage = prose(rng, 80)
    texts = [prose(rng, 120), prose(rng, 30) + " " + passage + " " + prose(rng, 40), passage, None, "", prose(rng, 49), passage + "\n" + passage, prose(rng, 10) + "\t" + passage[: len(passage) // 2]]
    texts += [f"{prose(rng, 60)}  {passage}" for _ in range(5)] + [texts[0], "a " * 200]
    rows = [(k * 3, t, "extra") for k, t in enumerate(texts)] + [(0, texts[0], None), (5, texts[2], None)]
    seen = defaultdict(list)
    for d, t, _ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].append(d)
    want = Counter()
    for d, t, _ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 49):
            if min(seen[tuple(w[k : k + 50])]) < d:
                gone |= set(range(k, k + 50))
        want[d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = substring_dedup.repeated_windows(df).collect()
    assert Counter((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == want
    assert all(sum(i["end"] - i["begin"] for i in r["removed"]) == r["n_removed"] for r in got)
    assert any(n for _, _, n, _ in want)
    assert substring_dedup.repeated_windows(nothing).count() == 0
    monkeypatch.setattr(_grams.chunked, "__defaults__", (700,))  # many chunks, and ids in several
    got = substring_dedup.repeated_windows(df).collect()
    assert Counter((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == want
    lone = substring_dedup.repeated_windows(df.unionByName(spark.createDataFrame([(None, passage, None)], df.schema))).where("id is null").collect()
    assert [(r["n_removed"], r["kept"]) for r in lone] == [(80, "")]


# ---------------------------------------------------------------- 1


def test_context_trees_are_a_code(monkeypatch):
    rng = random.Random(1)
    counts = {}
    for lang, letters in (("a", "abcd "), ("b", "cdef. ")):
        grams = Counter()
        for _ in range(300):
            raw = ("\n\n\n" + "".join(rng.choice(letters) for _ in range(30))).encode()
            for k in range(len(raw) - 3):
                grams[int.from_bytes(raw[k : k + 4], "big")] += 1
        counts[lang] = np.array(list(grams)), np.array(list(grams.values()))
    trees = language_id.ContextTrees(counts)
    chance = 2.0 ** -trees.bits.astype(float)
    chance[:, 0] *= 256 - (trees.size - 1)
    assert np.allclose(chance.sum(1), 1, atol=1e-5)

    def slow(lang, text):
        """One byte after the other, with escapes and exclusion."""
        grams = dict(zip(*counts[lang], strict=True))
        by = [defaultdict(Counter) for _ in range(4)]
        for g, n in grams.items():
            raw = int(g).to_bytes(4, "big")
            for k in range(4):
                by[k][raw[3 - k : 3]][raw[3]] += n
        bits, raw = 0.0, b"\n\n\n" + text
        for k in range(3, len(raw)):
            out: set = set()
            for order in (3, 2, 1, 0):
                seen = {s: n for s, n in by[order].get(raw[k - order : k], {}).items() if s not in out}
                total = sum(seen.values()) + len(seen)
                if raw[k] in seen:
                    bits -= np.log2(seen[raw[k]] / total)
                    break
                if seen:
                    bits -= np.log2(len(seen) / total)
                    out |= set(seen)
            else:
                bits += np.log2(256 - len(out))
        return bits

    texts = [b"abca dcb", b"fed. cd", "zwölf \x00".encode(), b""]
    got = trees.code_lengths(texts)
    want = np.array([[slow(lang, t) for lang in trees.languages] for t in texts])
    assert np.allclose(got, want, rtol=1e-4)
    monkeypatch.setattr(language_id, "SCORED_BYTES", 3)
    assert np.allclose(trees.code_lengths([*texts, b"abc d" * 50]), [*want, [slow(lang, b"abc d" * 50) for lang in trees.languages]], rtol=1e-4)


def test_many_languages_are_scored_block_by_block(spark):
    rng = random.Random(7)
    names = [f"l{k:03}" for k in range(230)]
    words = {n: ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(6)] for n in names}
    rows = [(k * 1000 + d, n, " ".join(rng.choice(words[n]) for _ in range(30))) for k, n in enumerate(names) for d in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2)
    counts = language_id.learned(df)
    assert sorted(counts) == names
    assert [n for b in language_id.blocks(counts, 1 << 20) for n in b] == names and len(language_id.blocks(counts, 1 << 20)) > 3
    assert all(len(b) == 1 for b in language_id.blocks(counts, 1))
    some = df.where("doc_id % 1000 < 2")
    small = language_id.identified(some, counts, 1 << 20).toPandas().sort_values("doc_id")
    whole = language_id.identified(some, counts).toPandas().sort_values("doc_id")
    assert (small["lang_pred"] == whole["lang_pred"]).all() and np.allclose(small["score"], whole["score"], atol=1e-4)
    assert (small["lang_pred"] == small["lang"]).mean() > 0.95


def test_language_id(spark, sf_dir, docs, nothing):
    found = language_id.op1_language_id(spark, sf_dir).toPandas()
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas()
    merged = found.merge(truth, on="doc_id")
    out = merged[merged["held_out"]]
    assert (out["lang_pred"] == out["lang"]).mean() > 0.95 and len(found) == len(truth)
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(found["doc_id"], found["held_out"], strict=True))
    every = language_id.identified(docs, language_id.learned(docs)).collect()
    assert Counter(r["doc_id"] for r in every) == Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    got = {r["doc_id"]: r for r in every}
    for k, text in enumerate([None, "", "  \n\t "]):
        assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0), text
    assert got[3]["lang_pred"] in ("en", "fr", "de") and 0 < got[3]["score"] <= 1
    assert got[3]["label"] is None and got[3]["id"] == "id"
    assert language_id.identified(nothing, language_id.learned(nothing)).count() == 0
    assert {r["lang_pred"] for r in language_id.identified(docs, {}).collect()} == {"und"}


# ---------------------------------------------------------------- 4


def test_kneser_ney_against_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(3, 80))) for _ in range(60)]
    rows = [(k, t, "xx") for k, t in enumerate(texts)] + [(900, "never seen: ÄÖ", "xx"), (901, None, "xx"), (902, "", "xx"), (903, "abc", None), (904, "abc", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(40)] + [(3,), (None,)], "id long")
    got = {r["id"]: r["perplexity"] for r in quality.perplexities(docs, trusted).collect()}

    four = Counter()
    for t in texts[:40]:
        raw = b"\n\n\n" + t.encode()
        for k in range(len(raw) - 3):
            four[raw[k : k + 4]] += 1
    tables = [None, None, None, None, four]
    for order in (3, 2, 1):
        tables[order] = Counter(g[1:] for g in tables[order + 1])
    discount = [None] * 5
    for order in (1, 2, 3, 4):
        n = [0, *(sum(c == k for c in tables[order].values()) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        discount[order] = []
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[1] + n[2] else -1
            discount[order].append(d if 0 < d <= k else 0.5 * k)

    def p(gram):
        order = len(gram)
        if not order:
            return 1 / 256
        lower = p(gram[1:])
        seen = {g: c for g, c in tables[order].items() if g[:-1] == gram[:-1]}
        total = sum(seen.values())
        if not total:
            return lower
        cut = {g: min(c, discount[order][min(c, 3) - 1]) for g, c in seen.items()}
        return (seen.get(gram, 0) - cut.get(gram, 0)) / total + sum(cut.values()) / total * lower

    for k, t, lang in rows:
        if lang != "xx" or not t:
            assert got[k] is None
            continue
        raw = b"\n\n\n" + t.encode()
        logs = [np.log(p(raw[i : i + 4])) for i in range(len(raw) - 3)]
        assert got[k] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-4), t


def test_every_language_with_trusted_text_is_judged(spark):
    rows = [(k, f"{'abcdefg'[k % 7]} plain text of language {k}" * (2 if k < 230 else 1), f"l{k:03}") for k in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.perplexities(docs, docs.select(F.col("doc_id").alias("id"))).collect()
    assert len(got) == 250 and all(r["perplexity"] is not None for r in got)


def test_quality(spark, sf_dir, docs, nothing):
    got = quality.op4_quality(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    merged = got.merge(labels, on="doc_id")
    assert merged[merged["quality"] == 1]["kept"].mean() > 0.95
    assert merged[merged["quality"] == 0]["kept"].mean() < 0.3
    trusted = docs.select(F.col("doc_id").alias("id")).where("id < 30")
    rows = quality.judged(docs, trusted).collect()
    assert len(rows) == docs.count()
    assert [r["kept"] for r in rows if r["id"] in (0, 1)] == [False, False]
    assert quality.judged(nothing, trusted).count() == 0
    assert quality.judged(docs, trusted.limit(0)).where("perplexity is not null").count() == 0


# ---------------------------------------------------------------- 5


def exact_neighbours(rows, asked, k=5):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], float)
    out = {}
    for q in asked:
        w = v[list(ids).index(q)]
        score = (v * w).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((w * w).sum()))
        out[q] = [(int(ids[j]), score[j]) for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != q][:k]
    return out


def test_neighbours_recall(spark, monkeypatch):
    """2,000 vectors, of which under a tenth are ranked exactly; also with cells in many lists."""
    sf_dir = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert len(rows) >= 2000 and nearest.RERANKED < 0.1 * len(rows)
    want = exact_neighbours(rows, [i for i, _ in rows if i % 50 == 0])
    for most in (nearest.LIST, 20):
        monkeypatch.setattr(nearest, "LIST", most)
        got = nearest.op5_nearest(spark, sf_dir).toPandas()
        hits = sum(len({j for j, _ in want[q]} & set(part["vec_id"])) for q, part in got.groupby("query_id"))
        assert hits >= 0.9 * sum(map(len, want.values())), hits / sum(map(len, want.values()))
        for q, part in got.groupby("query_id"):
            assert part.sort_values("rank")["score"].is_monotonic_decreasing and q not in set(part["vec_id"]) and len(part) == 5


def test_neighbours_of_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    same_vector = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(k, same_vector, 1) for k in range(0, 400, 10)] + [(1000 + k, rng.normal(size=8).astype(np.float32).tolist(), 2) for k in range(7)]
    bad = [(2000, None, 0), (2050, [0.0] * 8, 0), (2100, [float("nan")] * 8, 0), (2150, [1.0, None, *[0.0] * 6], 0), (2200, [float("inf"), *[0.0] * 7], 0), (2250, [1.0, 2.0], 0), (None, same_vector, 0), (2300, [], 0)]
    df = spark.createDataFrame(rows + bad + [rows[0]], "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in nearest.neighbours(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    asked = [i for i, *_ in rows if i % 50 == 0]
    want = exact_neighbours([(i, v) for i, v, _ in rows], asked)
    assert got == {q: [j for j, _ in found] for q, found in want.items()}
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert nearest.neighbours(few, F.col("id") % 50 == 0).count() == 4
    assert nearest.neighbours(few.limit(0), F.col("id") % 50 == 0).count() == 0
    assert nearest.neighbours(few.limit(1), F.col("id") % 50 == 0).count() == 0


# ---------------------------------------------------------------- 7


def plain_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(x) if k % 2 == 0 else sum(map(int, str(2 * int(x)))) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(7)
    for _ in range(5000):
        text = "".join(rng.choice(["a", "1", "25", ".", "@", "-", "+", " ", "(", ")", "4539148803436467", "x.y@z.de", "é", "1.2.3.4"]) for _ in range(rng.randrange(25)))
        assert sorted(pii.base_spans(text)) == plain_spans(text), text


def test_pii(spark, sf_dir, docs, nothing):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.op7_pii(spark, sf_dir).collect():
        base = plain_spans(texts[r["doc_id"]])
        named = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == i for x in base) for i in range(4)]
        assert set(named.split(",")) <= set(r["spans"].split(",")) if named else r["spans"] == ""
    assert pii.personal_data(nothing).count() == 0
    assert all(r["spans"] == [] for r in pii.personal_data(docs).collect() if r["id"] < 10)


def test_beliefs_are_exact_marginals_on_trees():
    rng = np.random.default_rng(5)
    size = len(pii.KINDS) + 1

    def symmetric():
        x = rng.normal(size=(size, size))
        return x + x.T

    for links in ([], [(0, 2)], [(0, 4), (1, 3)]):
        for evidence in ([4] * 5, [4, 4, 1, 4, 4]):
            field = pii.Field(rng.normal(size=(size, 12)), symmetric(), symmetric())
            looks = rng.integers(0, 2, (5, 12)).astype(float)
            # a tree: with links, the chain is cut where it would close a circle
            edges = [(k, k + 1) for k in range(4)] if not links else []
            chain = pii._edges
            pii._edges = lambda n, links_, e=edges: e
            try:
                got = field.beliefs(looks, evidence, links, 200)
            finally:
                pii._edges = chain
            want = np.zeros((5, size))
            for y in itertools.product(range(size), repeat=5):
                if any(e != 4 and e != v for e, v in zip(evidence, y, strict=True)):
                    continue
                score = sum(looks[k] @ field.unary[y[k]] for k in range(5) if evidence[k] == 4)
                score += sum(field.chain[y[a], y[b]] for a, b in edges) + sum(field.skip[y[a], y[b]] for a, b in links)
                for k in range(5):
                    want[k, y[k]] += np.exp(score)
            assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-4)


def test_skip_links_reach_the_nearest_compatible_base():
    text = "+1 415 555 7713, +44 415 555 7713, +49 415 555 7713 x 987654321 415 555 7713 a@b.de or a (at) b.de"
    nodes = pii.mentions(text, pii.base_spans(text))
    key = {k: x[3] for k, x in enumerate(nodes)}
    links = {(key[a], key[b]) for a, b in pii.skips(nodes)}
    assert ("494155557713", "9876543214155557713") not in links and ("a@bde", "a@bde") in links
    many = ", ".join(f"+{k} 4155557713" for k in range(30, 60)) + ", (33) 4155557713"
    nodes = pii.mentions(many, pii.base_spans(many))
    assert ("334155557713", "334155557713") in {(nodes[a][3], nodes[b][3]) for a, b in pii.skips(nodes)}


def test_links_are_learned():
    """Where repetitions have other labels than what they repeat, the learned links don't carry them."""
    plain = ["call +1 (415) 555-7713 or +1 415 555 7713 now", "id 123456789012 and 99 of 1234567"] * 50
    field = pii.Field.trained(Counter(x for t in plain for x in pii.terms(t)))
    assert field.skip[3, 3] > field.skip[3, 4] + 1 and (field.skip == field.skip.T).all() and (field.chain == field.chain.T).all()
    odd = {((0.0,) * 12, 3, (0,) * 5, (0, 0, 1, 0, 0)): 50, ((0.0,) * 12, 2, (0,) * 5, (0, 0, 0, 1, 0)): 50}
    other = pii.Field.trained(odd)
    assert other.skip[3, 2] > other.skip[3, 3]


def test_skip_chains_carry_labels():
    texts = ["call +1 (415) 555-7713 now", "id 123456789012 and 99 of 1234567", "mail a.b@c.de today", "pay 4539 1488 0343 6467 or 9807915762804490", "host 10.0.0.1 up"] * 20
    field = pii.Field.trained(Counter(x for t in texts for x in pii.terms(t)))

    def added(text):
        return [(pii.KINDS[k], text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text), field)]

    assert added("call +1 (415) 555-7713 or 415 555 7713 today") == [("phone", "415 555 7713")]
    assert added("bob.smith@example.com or bob.smith (at) example.com") == [("email", "bob.smith (at) example.com")]
    assert added("order 123456789012 for +1 (415) 555-7713") == []
    assert added("order 123456789012 and 123456789012 again") == []
    far = "; ".join(f"of 2024{k:03}, word" for k in range(100, 160))
    assert added(f"4539 1488 0343 6467, {far}, 4539.1488.0343.6467") == [("card", "4539.1488.0343.6467")]
    for clean in ("In 1999-2003 it sold 12,345,678 copies; ISBN 978-3-16-148410-0.", "Version 2.10.4 of 20240131, build 1234567890.", "no data at all"):
        assert added(clean) == [], clean


def test_lone_mentions_are_judged_too(spark):
    texts = ["call +1 (415) 555-7713 now", "mail a.b@c.de today", "pay 4539 1488 0343 6467 now", "host 10.0.0.1 up", "id 123456789012 and 99 of 1234567"] * 200
    texts += ["call (415) 555-7713 now", "10.0.0.1 is up, call (415) 555-7713 now", "mail bob@ mail.example.org", "order 123456789012", "no data"]
    found = {r["id"]: [texts[r["id"]][x["start"] : x["end"]] for x in r["spans"]] for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[k] for k in range(1000, 1005)] == [["(415) 555-7713"], ["10.0.0.1", "(415) 555-7713"], ["bob@ mail.example.org"], [], []]


# ---------------------------------------------------------------- 10


def test_main_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extraction.op10_html_extraction(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if x == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", article.replace("<br>", " "))]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body class="no-sidebar"><header><h1>Site</h1></header>
<nav><ul><li>menu</ul></nav><div class="cookie-notice">We use cookies</div><main><header><h1>Head &amp; line</h1></header><p>First   para<p>Second <b>bold</b> &lt;tag&gt; caf&eacute;&nbsp;x<br>line
<div class="ad banner">Buy</div><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><form><input><label>mail</label></form><p hidden>gone</p>
<section id="comments"><p>Reader says</p></section></main><aside>side</aside><footer>foot</footer><!-- <p>no</p> --></body></html>"""


def test_markup():
    assert html_extraction.Page(PAGE).text().split("\n") == ["Head & line", "First para", "Second bold <tag> café x line", "one", "two", "a", "b"]
    for odd in ("", "plain text", "<p>a<", "<p>a</div></p>b", "<a href='x>y</a> z", "<!-- open", "<script>never closed", "</p></p>", "<p>1 < 2 & 3</p>", "<div" * 500, "<b>" * 3000 + "x"):
        html_extraction.Page(odd).text()
    assert html_extraction.Page("<p>1 < 2 &amp 3</p>").text() == "1 < 2 & 3"


def test_hostile_pages_take_linear_time():
    for part, end in (("<div>", ""), ("<a ", ""), ("<a '", ">"), ('<a "', ""), ("<p><ul>", ""), ("<div></p></b>", ""), ("<!--", ""), ("<script ", ""), ("&", ""), ("<div class='a b'>x", "")):
        for n in (4000, 32_000):
            began = time.process_time()
            page = html_extraction.Page(part * n + end)
            page.text()
            assert time.process_time() - began < 4, (part, n)
    assert len(html_extraction.Page("<div>" * 8000 + "x").styles) == 8000


def test_importance_against_brute_force(spark):
    """Entropies of texts and of child sequences at each path, worked out page by page."""
    rng = random.Random(11)
    rows = []
    for k in range(12):
        body = f"<div class='a'>{rng.choice(['same', 'same', 'other'])}</div><div class='b'>{'<p>one</p>' * 1}{'<ul><li>x</ul>' * (k % 3 == 0)}own {k}</div>"
        rows.append((k, "http://h.example/", f"<body>{body}</body>"))
    got = {r["path"]: r for r in html_extraction.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    def entropy(counts, base):
        total = sum(counts.values())
        return -sum(n / total * np.log(n / total) for n in counts.values()) / np.log(base)

    for names in (("body", "div.a"), ("body", "div.b"), ("body", "div.b", "p"), ("body", "div.b", "ul", "li")):
        path = html_extraction.path_id(names)
        pages = [p for p in (html_extraction.Page(r[2]) for r in rows) if any(b[0] == path for b in p.blocks)]
        texts = Counter(t for p in pages for t in {b[1] for b in p.blocks if b[0] == path})
        shows = Counter(s for p in pages for s in p.styles[path])
        many = len(pages)
        # a text's entropy over the pages that have it, spread evenly
        content = 1 - sum(n * np.log(n) for n in texts.values()) / sum(texts.values()) / np.log(many)
        want = (1 - 0.9 ** len(shows)) * entropy(shows, many) + 0.9 ** len(shows) * content
        assert got[path]["pages"] == many and got[path]["importance"] == pytest.approx(want), names
    assert got[html_extraction.path_id(("body", "div.b"))]["importance"] > 0.5 > got[html_extraction.path_id(("body", "div.b", "p"))]["importance"]


def test_pages_without_marked_articles(spark, monkeypatch):
    """No article element and no telling names: the tree alone takes out what returns, on every host of some pages."""
    rng = random.Random(13)
    rows = []
    for host, n in (("a", 40), ("b", 6), ("c", 3)):
        for k in range(n):
            rows.append((len(rows), f"https://{host}.example/{k}", f"<body><table><tr><td>Home<td>About {host}</table><div class='qx'><p>{prose(rng, 30)}<p>{prose(rng, 9)}</div><div class='zx'><p>All rights of {host}</div></body>", None, "x"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host_ string, html_ string")
    for most in (html_extraction.LOW_MOST, 0):
        monkeypatch.setattr(html_extraction, "LOW_MOST", most)
        got = {r["page_id"]: r for r in html_extraction.main_text(pages).collect()}
        for k, _, source, *_ in rows:
            assert got[k]["main_text"].split("\n") == re.findall(r"<p>([^<]*)(?=<p>|</div><div)", source) and got[k]["html_"] == "x"


def test_style_tree_takes_out_what_every_page_has(spark):
    rng = random.Random(1)
    rows = [(k, f"http://Site.example/{k}", f"<body><div class='x'>Every page says this</div><div class='y'><p>{prose(rng, 20)}</p></div></body>", "extra") for k in range(60)]
    rows += [(100, None, None, None), (101, "no url", "", None), (102, "http://other.example", "<div class='x'>Only here</div>", None), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    got = {r["page_id"]: r["main_text"] for r in html_extraction.main_text(pages).collect()}
    assert all(got[k] == re.search("<p>(.*)</p>", rows[k][2])[1] for k in range(60))
    assert (got[100], got[101], got[102]) == ("", "", "Only here")
    assert html_extraction.main_text(pages.limit(0)).count() == 0


def test_style_tree_on_few_pages_and_copies(spark):
    rng = random.Random(2)

    def page(notice, text):
        return f"<body><div class='x'>{notice}</div><div class='y'><p>{text}</p></div></body>"

    texts = [prose(rng, 20) for _ in range(100)]
    rows = [(k, f"http://few.example/{k}", page("Every page says this", texts[k])) for k in range(15)]
    rows += [(k, f"http://two.example/{k}", page("Both pages say this", texts[k])) for k in (15, 16)]
    # many copies of one page, few other pages with texts of their own at the same paths
    rows += [(100 + k, "http://copies.example/", page("Copied", "the same")) for k in range(1000)]
    rows += [(k, f"http://copies.example/{k}", page(f"own {k}", texts[k])) for k in range(20, 40)]
    # a notice that most pages have and a few write anew
    rows += [(k, f"http://mixed.example/{k}", page("Usual" if k < 2400 else f"own {k}", f"text {k}")) for k in range(2000, 2410)]
    rows += [(3000 + k, "http://lone.example/", page("All", "there is")) for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["main_text"] for r in html_extraction.main_text(pages).collect()}
    assert all(got[k] == texts[k] for k in range(17))
    assert got[100] == "Copied\nthe same" and all(got[k] == f"own {k}\n{texts[k]}" for k in range(20, 40))
    assert got[2000] == "text 2000" and got[2409] == "own 2409\ntext 2409"
    assert got[3000] == "All\nthere is"


def test_components_both_ways(spark):
    from chunkloom.llm._components import components

    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    want = {x: find(x) for x in parent if any(x in (a, b) and a != b for a, b in links)}
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    for small in (10**6, 0):
        assert {r["id"]: r["component"] for r in components(df, small).collect()} == want
    assert components(df.limit(0)).count() == 0
