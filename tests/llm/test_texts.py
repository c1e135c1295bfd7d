"""Decontamination, token store, language ID, Jaccard join, language-model scores."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pyspark.sql.functions as F
import pytest

from tidelog.llm import jaccard_join, lm_score, words
from tidelog.llm.common import new_path, placed
from tidelog.llm.decontaminate import contamination, local_alignment
from tidelog.llm.jaccard_join import jaccard_classes, one_of_each, shingle_order
from tidelog.llm.language_id import fit_language_model, with_language
from tidelog.llm.lm_score import lm_scores
from tidelog.llm.queries import op10_lm_score
from tidelog.llm.token_store import PieceEncoder, crc_shifted, read_ids, read_store, write_store

os.environ["TOKENIZERS_PARALLELISM"] = "false"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ODD = ["", None, " ", "\t\n ", "one", "One two", "a b c d", "a b c d e", "A B C D E", "é ü", "x" * 100_000, "w " * 60_000]


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


# words

def test_word_and_ngram_hashes():
    texts = ["The quick\tthe", "", None, "QUICK the  quick the", " lead", "trail "]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    (_, data, offsets), = words.slices(batch, "t")
    h, owner = words.word_hashes(data, offsets)
    assert [Counter(owner.tolist())[i] for i in range(6)] == [3, 0, 0, 4, 1, 1]
    assert h[0] == h[2] == h[4] == h[6] and h[1] == h[3] == h[5] and h[0] != h[1]
    g, of = words.ngram_hashes(h, owner, 2)
    assert of.tolist() == [0, 0, 3, 3, 3] and g[0] == g[3] and g[1] == g[2] == g[4]
    for n in (2, 3):
        g, _ = words.ngram_hashes(h[3:7], owner[3:7], n)
        m = len(g)
        head, tail, middle = words.inner_hashes(g, h[3 : 3 + m], h[2 + n : 2 + n + m] if n > 2 else None, n)
        below = words.ngram_hashes(h[3:7], owner[3:7], n - 1)[0]
        assert (head == below[:m]).all() and (tail == below[1 : m + 1]).all()
    assert (words.unmixed(words.mixed(h)) == h).all()
    f = words.HashFilter(h[:2])
    assert f.passing(h[:2]).all()


def test_slices_cover_all_rows():
    texts = ["a" * n for n in (0, 10, 3_000_000, 5, 1_500_000, 900_000, 1)]
    parts = list(words.slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]).slice(1), "t"))
    assert [x for part, *_ in parts for x in part.column("t").to_pylist()] == texts[1:]
    assert all(len(d) == o[-1] for _, d, o in parts)


# decontamination

def smith_waterman(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), table[i - 1, j] - 0.5, table[i, j - 1] - 0.5)
    return table.max()


def test_recall_by_length_of_item(spark, make_docs):
    """Copies with 30 % of the words replaced at random, one word put in or taken out, or every third word replaced."""
    rng = random.Random(25)
    lengths = [3, 4, 5, 6, 8, 12, 20, 60]
    items, rows, due = [], [(i, prose(rng, 200, 9000)) for i in range(20)], {}
    for n in lengths:
        for k in range(40):
            w = prose(rng, n, 9000).split()
            items.append((len(items), " ".join(w)))
            copy = list(w)
            if k % 4 == 1 and n > 5:
                copy.insert(rng.randrange(1, n), "put")
            if k % 4 == 2 and n > 5:
                del copy[rng.randrange(n)]
            for j in range(2, len(copy), 3) if k % 4 == 3 else rng.sample(range(len(copy)), max(1, round(0.3 * len(copy)))):
                copy[j] = f"other{j}"
            text = f"{prose(rng, 20, 9000)} {' '.join(copy)} {prose(rng, 20, 9000)}"
            rows.append((1000 + len(items), text))
            if smith_waterman(w, text.split()) >= 0.5 * n:
                due[1000 + len(items)] = n
    got = {r["doc_id"]: r["contaminated"] for r in contamination(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = {n: sum(got[d] for d, m in due.items() if m == n) / max(1, sum(m == n for m in due.values())) for n in lengths}
    print("recall", recall, "due", Counter(due.values()))
    assert min(recall.values()) >= 0.9 and recall[60] == 1


def test_alignment():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert local_alignment(np.array(a), np.array(b)) == pytest.approx(smith_waterman(a, b))


def test_contamination(spark, make_docs):
    rng = random.Random(5)
    items = [(i, prose(rng, 40, 5000)) for i in range(6)] + [(6, "short"), (7, None), (8, ""), (3, prose(rng, 30, 5000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = items[1][1].split()
    edited[5], edited[17] = "other", "words"
    del edited[25]
    rows = [(i, prose(rng, 300, 5000)) for i in range(20)]
    rows += [(100, prose(rng, 200, 5000) + " " + items[0][1] + " " + prose(rng, 50, 5000)), (101, "pre " + " ".join(edited).upper()), (102, items[2][1]), (102, items[2][1]), (None, items[4][1]), (104, None), (105, ""), (106, "short")]
    rows += [(200 + i, f"{prose(rng, 5, 5000)} {items[5][1]}, {prose(rng, 5, 5000)}") for i in range(30)]
    got = contamination(make_docs(rows).withColumnRenamed("lang", "score"), bench).collect()
    assert len(got) == len(rows)
    flagged = Counter(r["doc_id"] for r in got if r["contaminated"])
    assert flagged == Counter([100, 101, 102, 102, None, *range(200, 230)])
    assert next(r for r in got if r["doc_id"] == 101)["item_id"] == 1
    assert contamination(make_docs([]), bench).count() == 0
    assert contamination(make_docs(rows[:3]), bench.limit(0)).filter("contaminated").count() == 0


def test_contamination_of_edited_copies(spark, make_docs):
    rng = random.Random(15)
    items = [prose(rng, 40, 5000) for _ in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, prose(rng, 200, 5000)) for i in range(10)]
    for i, item in enumerate(items):
        w = item.split()
        gone = range(4, 40, 5) if i < 3 else rng.sample(range(40), (8, 10, 12)[i % 3])  # 20 to 30 % replaced
        for j in gone:
            w[j] = f"other{j}"
        rows.append((100 + i, f"{prose(rng, 30, 5000)} {' '.join(w)} {prose(rng, 30, 5000)}"))
    w = items[0].split()[:28]
    w[9], w[19] = "other", "words"
    rows.append((200, " ".join(w)))  # a part of an item, edited
    want = {d: max(smith_waterman(x.split(), t.split()) / 40 for x in items) for d, t in rows if d >= 100}
    got = {r["doc_id"]: r for r in contamination(make_docs(rows), bench).collect()}
    assert want[100] > 0.6 and {d: got[d]["score"] for d in want} == pytest.approx(want)
    assert all(got[d]["contaminated"] == (want[d] >= 0.5) for d in want) and all(got[100 + i]["item_id"] == i for i in range(12))
    assert not any(got[i]["contaminated"] for i in range(10))


# token store

def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_pieces_encode_as_the_tokenizer():
    path, plain = tokenizer()
    rng = random.Random(1)
    alphabet = ["a", "B", "don't", "'s", "'", "1", "²", "é", "É", "e\u0301", "…", "–", ".", ",", "&&&", "<|endoftext|>", "<|", "<|ENDOFTEXT|>", "\t", "\n", " ", "\x1c", "\x85", "\u00a0", "日本", "İ", "Σ", "ς", "x" * 300, "ß", "_", "🙂", "Ⅷ", "'RE"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + ["", None]
    encoder, i = PieceEncoder(path), 0
    for _, data, offsets in words.slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), "t"):
        ids, ends = encoder.encode(data, offsets)
        for part in np.split(ids, ends[:-1]):
            assert part.tolist() == [*plain.encode(texts[i] or "", add_special_tokens=False).ids, 2], texts[i]
            i += 1
    assert i == len(texts)


def test_slice_of_more_pieces_than_are_kept(monkeypatch):
    monkeypatch.setattr("tidelog.llm.token_store.CACHED_PIECES", 3)
    path, plain = tokenizer()
    encoder = PieceEncoder(path)
    for text in ("aa bb", "aa bb cc dd ee 11 22", "cc", "bb ff 11 gg hh ii"):
        ids, _ = encoder.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_shifted_crcs_add_up():
    a, b, c = b"abc" * 40, b"\0\0xyz", b"q" * 1001
    parts = crc_shifted(np.array([zlib.crc32(a), zlib.crc32(b), zlib.crc32(c)]), np.array([len(b + c), len(c), 0]))
    assert parts[0] ^ parts[1] ^ parts[2] == zlib.crc32(a + b + c)


def test_token_store_round_trip(spark, make_docs):
    path, plain = tokenizer()
    rng = random.Random(6)
    long = prose(rng, 6000)
    rows = [(i, prose(rng, rng.randint(0, 400))) for i in range(30)] + [(50, long), (51, long + " end"), (52, "pre " + long), (53, None), (54, ""), (55, ODD[10]), (56, ODD[11]), (7, "again")]
    store = new_path(spark, "test-store")
    write_store(make_docs(rows), store, path)
    got = {}
    for r in read_store(spark, store).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    start, seen = 0, Counter()
    rebuilt = {r["start"]: r["ids"] for r in read_ids(spark, store).collect()}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        if doc == 7:  # two rows of one id, in either order
            start += sum(x[1] for x in got[7]) if not seen[7] else 0
            seen[7] += 1
            continue
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[doc] == [(start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))]
        assert rebuilt[start] == ids
        start += len(ids)
    chunks = spark.read.parquet(f"{store}/chunks")
    total = sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert chunks.groupBy("digest").count().filter("count > 1").count() == 0
    assert chunks.agg({"n": "sum"}).first()[0] < 0.7 * total  # copies share chunks
    empty = new_path(spark, "test-store")
    write_store(make_docs([]), empty, path)
    assert read_store(spark, empty).count() == 0


def test_token_files_follow_the_ids(spark, make_docs, tmp_path, monkeypatch):
    """Several recipe files: ids and starts ascend within each and from file to file; packs hold many parts."""
    path, _ = tokenizer()
    monkeypatch.setattr("tidelog.llm.token_store.PART_CHUNKS", 3)
    monkeypatch.setattr("tidelog.llm.token_store.PACK_PARTS", 4)
    rng = random.Random(16)
    rows = [(i, prose(rng, rng.choice([3, 900]))) for i in rng.sample(range(1000), 80)]
    store = str(tmp_path / "store")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_store(make_docs(rows), store, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "store" / "recipes").glob("part-*.parquet"))
    tables = [pq.ParquetFile(f).read(columns=["doc_id", "start"]) for f in files]
    ids, starts = ([x for t in tables for x in t.column(c).to_pylist()] for c in ("doc_id", "start"))
    assert sum(t.num_rows > 0 for t in tables) > 3 and ids == sorted(i for i, _ in rows) and starts == sorted(starts) and starts[0] == 0
    packs = spark.read.parquet(f"{store}/chunks").groupBy("pack").agg({"digest": "min"}).orderBy("pack").collect()
    assert len(packs) > 2 and [r[1] for r in packs] == sorted(r[1] for r in packs)
    assert read_store(spark, store).count() == 80


def test_token_store_notices_damage(spark, make_docs):
    path, _ = tokenizer()
    store = new_path(spark, "test-store")
    write_store(make_docs([(1, "some words here"), (2, "and others")]), store, path)
    chunks = spark.read.parquet(f"{store}/chunks").collect()
    schema = "digest binary, n int, ids binary, pack int"
    bad = [(r["digest"], r["n"], bytes(reversed(r["ids"])), r["pack"]) for r in chunks]
    spark.createDataFrame(bad, schema).write.mode("overwrite").partitionBy("pack").parquet(f"{store}/chunks")
    with pytest.raises(Exception, match="digest"):
        read_store(spark, store).collect()


# language ID

def test_language_id(make_docs):
    rng = random.Random(8)
    stems = {"en": ["the", "ing", "tion"], "de": ["sch", "ung", "keit"], "fr": ["eau", "ère", "oui"], "es": ["ción", "ado", "ía"], "xx": ["qq", "zz", "kk"]}
    make = lambda k: " ".join("".join(rng.choice(stems[k]) for _ in range(2)) for _ in range(30))
    rows = [(i, make(k), k, "s") for i in range(60) for k in stems]
    model = fit_language_model(make_docs(rows[:200]))
    tests = rows[200:] + [(1, None), (2, ""), (3, "123 !?"), (4, "the " * 50_000, "de", "s")]
    got = with_language(make_docs(tests).withColumnRenamed("n_chars", "lang_pred"), model).collect()
    assert len(got) == len(tests)
    for r in got:
        assert 0 <= r["score"] <= 1
        if not re.search("[a-zé]", r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        elif len(r["text"]) < 10_000:
            assert r["lang_pred"] == r["lang"]
    nothing = fit_language_model(make_docs([(1, "x", None, "s")]))
    assert with_language(make_docs([(1, "text")]), nothing).first()["lang_pred"] == "und"
    one = fit_language_model(make_docs([(1, "abc", "en", "s")]))
    assert with_language(make_docs([(1, "text")]), one).first()["lang_pred"] == "en"
    assert with_language(make_docs([]), model).count() == 0


# Jaccard join

def components(rows):
    sets = []
    for doc, text in rows:
        w = word_list(text)
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, s) in enumerate(sets):
        for j in range(i):
            t = sets[j][1]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            best[find(i)] = min(best.get(find(i), doc), doc)
    return Counter((doc, len(s), best.get(find(i))) for i, (doc, s) in enumerate(sets))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("most", [0, 1000])
def test_sets_outside_of_pairs_stay_where_they_are(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "SENT", most)
    sets = spark.createDataFrame([(i, 8, [*range(7), 100 + i // 3]) for i in range(30)], "row long, n long, s array<long>")
    pairs = spark.createDataFrame([(1, 0), (4, 3), (5, 0), (29, 2), (2, 0)], "a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the sets were large
    try:
        got = jaccard_join.verified(pairs, sets)
        assert {tuple(r) for r in got.collect()} == {(1, 0), (4, 3), (5, 0), (29, 2), (2, 0)}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert most == 0 or "hashpartitioning(a#" not in plan
        assert jaccard_join.verified(pairs, sets.withColumn("s", F.transform("s", lambda x: x + F.col("row")))).count() < 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_jaccard_classes(make_docs):
    rng = random.Random(9)
    base, passage = prose(rng, 120), prose(rng, 60)
    rows = [(1000 + i, edited(rng, base, rng.randint(0, 5))) for i in range(60)]  # a large group of near copies
    rows += [(2000 + i, base) for i in range(40)] + [(3000 + i, f"{passage} {prose(rng, rng.choice([10, 20, 90]))}") for i in range(40)]
    rows += [(4000 + i, edited(rng, passage, i % 4)) for i in range(20)] + [(i, t) for i, t in enumerate(ODD)] + [(5, "One two"), (None, base), (None, "one"), (None, None)]
    # a chain: neighbours link, ends don't
    chain = [f"c{i}" for i in range(300)]
    rows += [(6000 + i, " ".join(chain[i * 12 : i * 12 + 100])) for i in range(12)]
    got = jaccard_classes(make_docs(rows).withColumnRenamed("lang", "row"))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == components(rows)
    assert jaccard_classes(make_docs([])).count() == 0


def test_large_groups_that_overlap_without_linking(make_docs):
    rng = random.Random(19)
    base = [f"a{i}" for i in range(200)]
    other = base[:110] + [f"b{i}" for i in range(90)]  # shares about half of its shingles with the first
    rows = [(i, edited(rng, " ".join(base), rng.randint(0, 4))) for i in range(150)] + [(500 + i, edited(rng, " ".join(other), rng.randint(0, 4))) for i in range(150)]
    rows += [(900 + i, edited(rng, " ".join(base), rng.randint(6, 20))) for i in range(60)]  # too far from the rest, mostly
    got = jaccard_classes(make_docs(rows))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == components(rows)


def test_every_link_of_small_sets(make_docs):
    rng = random.Random(20)
    rows = [(i, prose(rng, rng.randint(1, 14), 3)) for i in range(250)]
    got = jaccard_classes(make_docs(rows))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == components(rows)


def test_shingle_levels(make_docs):
    texts = ["a b c d e f"] * 3 + ["a b c d e x", "q r s t u v w"] + ["h i j k l"] * 20
    order = shingle_order(make_docs(list(enumerate(texts))))
    level = lambda t: order.levels(words.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5)[0]).tolist()
    assert (level("a b c d e"), level("b c d e f"), level("r s t u v"), level("h i j k l"), level("not in any of them")) == ([2], [1], [0], [3], [0])


def test_rows_keep_their_numbers_however_files_are_split(spark, make_docs, tmp_path):
    make_docs([(i, "t") for i in range(4000)]).repartition(4).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "docs"))
    seen = []
    for least in ("1", "16"):
        spark.conf.set("spark.sql.files.minPartitionNum", least)
        docs = spark.read.parquet(str(tmp_path / "docs"))
        seen.append({(r["at"], r["doc_id"]) for r in placed(docs, "at").collect()})
    spark.conf.unset("spark.sql.files.minPartitionNum")
    assert seen[0] == seen[1] and len({a for a, _ in seen[0]}) == 4000
    assert len({r["at"] for r in placed(make_docs([(1, "x")] * 50), "at").collect()}) == 50


def test_one_of_each(make_docs):
    rng = random.Random(10)
    base = prose(rng, 100)
    rows = [(5, base), (3, edited(rng, base, 1)), (9, base), (3, base), (1, None), (2, ""), (4, prose(rng, 50)), (None, base)]
    assert Counter(r["doc_id"] for r in one_of_each(make_docs(rows)).collect()) == Counter([3, 1, 2, 4])


# language-model scores

@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores(make_docs, order):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(0, 80), 30)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(1, "w1 w2"), (None, "W1 w2 w3")]
    lists = [word_list(t) for _, t in rows]
    count = Counter(tuple(w[i : i + n]) for w in lists for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(len(w) for w in lists)

    def score(g):
        if len(g) == 1:
            return math.log(count[g] / total)
        return math.log(count[g] / count[g[:-1]]) if count[g] >= 2 else math.log(0.4) + score(g[1:])

    want = sorted((doc is None, doc or 0, len(w), round(sum(score(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w))), 4)) for (doc, _), w in zip(rows, lists, strict=True))
    got = lm_scores(make_docs(rows).withColumnRenamed("lang", "h"), order=order).collect()
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], round(r["log_prob"], 4)) for r in got)
    assert len(found) == len(want) and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-2 for a, b in zip(found, want, strict=True))
    assert all((r["per_word"] is None) == (r["n_words"] == 0) for r in got)
    assert lm_scores(make_docs([])).count() == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_scores_of_all_ngrams(spark, make_docs, tmp_path, order):
    rng = random.Random(16)
    rows = [(i, prose(rng, rng.randint(0, 60), 30)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(1, "w1 w2"), (None, "W1 w2 w3")]
    lists = [word_list(t) for _, t in rows]
    count = Counter(tuple(w[i : i + n]) for w in lists for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))
    total = sum(len(w) for w in lists)

    def score(g):
        return math.log(count[g] / (count[g[:-1]] if len(g) > 1 else total))

    want = sorted((doc is None, doc or 0, len(w), sum(score(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))) for (doc, _), w in zip(rows, lists, strict=True))
    docs = make_docs(rows).withColumnRenamed("lang", "h")
    for corpus in (None, docs) if order == 3 else (None,):  # the documents themselves, and the same as another table
        got = lm_scores(docs, order=order, min_count=1, corpus=corpus).collect()
        found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["log_prob"]) for r in got)
        assert len(found) == len(want) and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-2 for a, b in zip(found, want, strict=True))
    if order == 3:  # as the query is registered
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        got = op10_lm_score(spark, str(tmp_path)).collect()
        found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["log_prob"]) for r in got)
        assert all(abs(a[3] - b[3]) < 1e-2 for a, b in zip(found, want, strict=True))


def test_lm_score_shuffles_no_row_per_ngram(spark, make_docs, tmp_path):
    docs = [(i, " ".join(f"{i}x{k}" for k in range(1000))) for i in range(20)]
    make_docs(docs).write.parquet(str(tmp_path / "documents.parquet"))
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before = stages()
    assert op10_lm_score(spark, str(tmp_path)).count() == 20
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    passed = sum(n for stage, n in stages().items() if stage not in before)
    assert 20_000 <= passed < 40_000  # a row per word, not one more for each longer n-gram


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngram_counts_in_many_parts(make_docs, monkeypatch, n):
    rng = random.Random(17)
    docs = [(i, prose(rng, rng.randint(0, 300), 12)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)]
    text = [(t or "").encode() for _, t in docs]
    h, _ = words.ngram_hashes(*words.word_hashes(np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)])), n)
    count = Counter(h.view(np.int64).tolist())
    monkeypatch.setattr(lm_score, "HELD", 50)  # many runs a task
    monkeypatch.setattr(lm_score, "PART", 8)
    for least in (1, 2):
        got = [(r["h"], r["c"]) for r in lm_score.ngram_counts(make_docs(docs), n, least, None if n == 1 else len(h)).collect()]
        assert sorted(got) == sorted((g, c) for g, c in count.items() if c >= least)
    kept = lm_score.kept_filter(lm_score.ngram_counts(make_docs(docs), n, 2, None if n == 1 else len(h)))
    assert kept.passing(np.array([g for g, c in count.items() if c >= 2], np.int64).view(np.uint64)).all()
    assert (kept.words != 0).sum() <= sum(c >= 2 for c in count.values())
