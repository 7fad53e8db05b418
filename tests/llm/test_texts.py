"""Operators that see one text at a time, against their libraries or brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, normalizers

from seriesforge.llm import _arrow, decontaminate, language_id, packing, quality, simhash, token_count

ODD = [None, "", " ", "a", "The cat. Sat!", "x'S don't  I'LL", "É é É ﬁ ΣΑΣ", "a<|endoftext|> b <|startoftext|>", "日本語テスト。漢字", "tab\tand\r\nlines\x1c\x85 ", "  lead", "tail  ", "▁ ▁▁ a▁b", "\n\n a\n", "1234 5,6 $%&", "!" * 50, "word " * 3000, "x" * 5000, "<0x0A> <s>", "😀 a😀b"]


@pytest.fixture(scope="module")
def odd(make_docs):
    return make_docs(list(enumerate(ODD)) + [(4, ODD[4])], extra=True)


def test_word_spans_and_hashes():
    buf, offs = _arrow.string_buffer(pa.array(ODD))
    starts, ends, word_offs = _arrow.words(buf, offs)
    raw = buf.tobytes()
    for i, t in enumerate(ODD):
        assert [raw[a:b] for a, b in zip(starts[word_offs[i] : word_offs[i + 1]], ends[word_offs[i] : word_offs[i + 1]], strict=True)] == (t or "").encode().split()
    h = _arrow.word_hashes(buf, starts, ends)
    by_word = {}
    for a, b, x in zip(starts, ends, h.tolist(), strict=True):
        assert by_word.setdefault(raw[a:b], x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_counts_equal_the_library(odd):
    vocabulary = token_count.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    model.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(odd, vocabulary).collect()}
    assert got == {i: len(model.encode(t or "").ids) for i, t in enumerate(ODD)}


def test_counts_with_ties_and_joined_words():
    vocabulary = [("<unk>", -9.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("aa", -2.0), ("ab", -2.0), ("a▁b", -2.5), ("aab", -3.0)]
    model = Tokenizer(models.Unigram(vocabulary, unk_id=0))
    model.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    counter = token_count.Counter(vocabulary)
    assert not counter.by_word
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("aab ") for _ in range(rng.randrange(1, 12)))
        assert counter.count(text.encode())[0] == len(model.encode(text).ids), text


def packed(df, path):
    return packing.pack(df, path).collect()


def test_packing_is_a_round_trip(odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    got = packed(odd.repartition(3), path)
    pieces, sequences = {}, {}
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(ODD):
        want = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i])
        copies = 2 if i == 4 else 1
        assert sum(len(ids) for _, ids, _ in own) == copies * len(want)
        if copies == 1:
            assert [x for _, ids, _ in own for x in ids] == want and own[0][2] == len(want)
            assert [s for s, _, _ in own] == np.cumsum([0, *(len(ids) for _, ids, _ in own)])[:-1].tolist()
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_other_operators_free_the_word_caches(odd):
    path = public_tokenizers.path("word_bpe_49k.json")

    def kept(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([packing.word_tokenizer.cache_info().currsize])], names=["kept"]) for _ in batches)

    packing.word_tokenizer(path)
    assert list(_arrow.tidy(iter)([])) == [] and packing.word_tokenizer.cache_info().currsize == 0
    one = odd.coalesce(1)
    assert packing.pack(one, path).count() > 0
    assert {r.kept for r in one.mapInArrow(_arrow.tidy(kept), "kept long").collect()} == {0}


def test_packing_empty(make_docs):
    assert packed(make_docs([]), public_tokenizers.path("word_bpe_49k.json")) == []


def test_cuts_are_optimal():
    rng = np.random.default_rng(8)
    for _ in range(200):
        places = np.concatenate(([0], np.cumsum(rng.integers(1, 6, rng.integers(3, 25)))))
        penalty, window = rng.integers(0, 5, len(places)), int(rng.integers(6, 12))
        best = [0.0] + [float("inf")] * (len(places) - 1)
        for i in range(1, len(places)):
            for j in range(i):
                if places[i] - places[j] <= window:
                    best[i] = min(best[i], best[j] + window - (places[i] - places[j]) + penalty[i])
        got = packing.cuts(places, penalty, window)
        cost = 0
        for a, b in zip([0, *got], got):
            assert 0 < places[b] - places[a] <= window
            cost += window - (places[b] - places[a]) + penalty[b]
        assert cost == (best[got[-1]] if got else 0)


def test_places_in_long_sentences_are_made_at_once(monkeypatch):
    """A document without sentence ends is cut at every sixteenth token, with no call for each sentence."""
    rng = np.random.default_rng(9)
    sizes = [1, 15, 16, 17, 32, 33, *rng.integers(1, 90, 1000).tolist()]
    packer = packing.Packer(64, np.array([False, False, True]))
    for key, n in enumerate(sizes):
        assert not list(packer.add(key, np.array([0] * (n - 1) + [rng.integers(0, 3)], np.uint32)))
    stream = np.concatenate([d[2] for d in packer.docs])
    kind = {0: 0, **{i + 1: packing.SENTENCE_PENALTY for i in np.flatnonzero(stream == 2).tolist()}, **dict.fromkeys(np.cumsum(sizes).tolist(), 0)}
    ends = sorted(kind)
    for a, b in zip(ends, ends[1:]):
        kind.update(dict.fromkeys(range(a + packing.FORCED_STEP, b, packing.FORCED_STEP), packing.FORCED_PENALTY))
    places = np.array(sorted(kind))
    want = places[packing.cuts(places, np.array([kind[i] for i in places.tolist()]), 64)].tolist()
    made = []
    monkeypatch.setattr(packing.np, "arange", lambda *args, plain=np.arange: made.append(args) or plain(*args))
    assert packer._ends() == want
    assert len(made) < 10


# -- SimHash


def test_fingerprints(make_docs, odd):
    got = {}
    for r in simhash.fingerprint_documents(odd, partitions=5).collect():
        got.setdefault(r["doc_id"], []).append(r)
    order = sorted([(-i, t or "") for i, t in [*enumerate(ODD), (4, ODD[4])]])
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        rows = got[-i]
        assert rows[0]["n_chars"] == len(t)
        assert hashlib.sha256(edited.encode()).hexdigest() in {r["edited_sha256"] for r in rows}
        assert 0 <= rows[0]["near_edited"] <= 1 and 0 <= rows[0]["near_next"] <= 1
    assert len(got[4]) == 2 and got[0][0]["fingerprint"] == got[1][0]["fingerprint"] == "0" * 32
    assert simhash.fingerprint_documents(make_docs([])).count() == 0
    one = simhash.fingerprint_documents(make_docs([(5, "a b c d")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()


def plain_fingerprint(text):
    """Weighted votes of word pairs by the definition, with the library's term hashes."""
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
    raw = np.frombuffer(text.encode(), np.uint8)
    h = _arrow.word_hashes(raw, np.array([a for a, _ in spans], dtype=np.int64), np.array([b for _, b in spans], dtype=np.int64)) if spans else []
    size = [b - a for a, b in spans]
    terms = [(h[0:1], size[0])] if len(h) == 1 else [(_arrow.gram_hashes(h[i : i + 2], 2), size[i] + size[i + 1]) for i in range(len(h) - 1)]
    votes = [0] * 128
    for term, weight in terms:
        raw = term.tobytes() + _arrow.mix64(term ^ np.uint64(0x5851F42D4C957F2D)).tobytes()
        for k in range(128):
            votes[k] += weight if raw[k // 8] >> (7 - k % 8) & 1 else -weight
    return sum((v > 0) << (127 - k) for k, v in enumerate(votes))


def test_fingerprints_by_definition(spark, make_docs):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["ab", "c", "dée", "fgh"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + ["", "one", None]
    ids = [rng.choice([-1, 1]) * rng.getrandbits(63) for _ in texts]  # hashes as ids, from end to end
    ids[:4] = [-(1 << 63), (1 << 63) - 1, None, None]
    rows = list(zip(ids, texts, strict=True))
    got = simhash.fingerprint_documents(make_docs(rows).repartition(4), partitions=6).collect()
    known = [(i, t or "") for i, t in rows if i is not None]
    order = [t for _, t in sorted(known, key=lambda r: -r[0])]
    share = lambda x, y: 1 - (x ^ y).bit_count() / 128
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == len(rows) and len(by_id) == len(known)
    for k, (i, t) in enumerate(sorted(known, key=lambda r: -r[0])[:-1]):
        r, after = by_id[i], order[k + 1]
        own, changed = plain_fingerprint(t), plain_fingerprint(t[: len(t) - len(t) // 2] + after[: len(t) // 2])
        assert (int(r["fingerprint"], 16), int(r["edited_fingerprint"], 16)) == (own, changed)
        assert r["near_edited"] == pytest.approx(share(own, changed)) and r["near_next"] == pytest.approx(share(own, plain_fingerprint(after)))


def test_many_rows_without_an_id_are_split(make_docs):
    rows = [(None, f"text number {i}") for i in range(300)] + [(7, f"other {i}") for i in range(300)] + [(i, "x y") for i in range(100, 110)]
    got = simhash.fingerprint_documents(make_docs(rows), partitions=8).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == sorted((i or -1, len(t)) for i, t in rows)
    parts = simhash._parts(make_docs(rows), 8).where("NOT guest").groupBy("part").count().collect()
    assert len(parts) > 5 and max(r["count"] for r in parts) < 250


def test_numbers_of_neighbours(make_docs):
    rows = [(i, f"w{i % 3} " + "a b c d e f g h i j k l m n o p " * 4 + "z" * (i % 2)) for i in range(120)] + [(200, None), (None, "a b c")]
    got = simhash.with_neighbours(simhash.fingerprint_documents(make_docs(rows)), 10).collect()
    prints = [int(r["fingerprint"], 16) for r in got]
    for r in got:
        if r["doc_id"] is None or r["doc_id"] % 10:
            assert r["n_near"] is None
        else:
            own = int(r["fingerprint"], 16)
            assert r["n_near"] == sum((own ^ x).bit_count() <= simhash.RADIUS for x in prints) - 1


def test_neighbours_are_all_found(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(128) for _ in range(20)]
    prints = set(base)
    for b in base:
        for _ in range(20):
            x = b
            for bit in rng.sample(range(128), rng.randrange(0, 10)):
                x ^= 1 << bit
            prints.add(x)
    rows = [(f"{x:032x}",) for x in prints] + [(None,)]
    got = {(r[0], r[1]) for r in simhash.neighbours(spark.createDataFrame(rows, "fingerprint string"), spark.createDataFrame([(f"{b:032x}",) for b in base], "fingerprint string")).collect()}
    assert got == {(f"{b:032x}", f"{x:032x}") for b in base for x in prints if (b ^ x).bit_count() <= simhash.RADIUS}


# -- decontamination


def plain_distance(item, text):
    """Least edit distance between item and any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def test_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        item = rng.integers(0, 6, rng.integers(1, 90)).astype(np.uint64)
        text = rng.integers(0, 6, rng.integers(0, 120)).astype(np.uint64)
        assert decontaminate.edit_distance(item, text) == plain_distance(item.tolist(), text.tolist())


def contaminated_corpus(seed):
    rng = random.Random(seed)
    some = lambda n: [f"v{rng.randrange(900)}" for _ in range(n)]
    items = [some(rng.randrange(6, 60)) for _ in range(40)] + [["one", "two"], some(3)]
    docs = []
    for k in range(300):
        doc = some(rng.randrange(0, 120))
        if k % 3:
            part = list(rng.choice(items))
            for _ in range(rng.randrange(0, max(1, len(part) // 4) + 1)):
                at = rng.randrange(len(part))
                kind = rng.randrange(3)
                if kind == 0:
                    part[at] = some(1)[0]
                elif kind == 1 and len(part) > 1:
                    del part[at]
                else:
                    part.insert(at, some(1)[0])
            at = rng.randrange(len(doc) + 1)
            doc[at:at] = [w.upper() if rng.random() < 0.3 else w + rng.choice(["", ",", "."]) for w in part]
        docs.append(doc)
    return items, docs


def test_decontamination_recall(spark, make_docs):
    items, docs = contaminated_corpus(9)
    clean = lambda ws: [w.lower().strip(",.") for w in ws]
    truth = {(i, j) for i, d in enumerate(docs) for j, item in enumerate(items) if plain_distance(item, clean(d)) <= decontaminate.allowed(len(item))}
    table = make_docs([*((i, " ".join(d)) for i, d in enumerate(docs)), (900, None), (901, "")], extra=True)
    bench = spark.createDataFrame([*((j, " ".join(i)) for j, i in enumerate(items)), (77, None), (78, ""), (79, " ".join(items[0]))], "item_id long, text string")
    got = decontaminate.contaminated(table, bench, block_bytes=2000).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] < 77}
    assert found <= truth and len(found) >= 0.9 * len(truth) > 50
    exact = {(i, j) for i, j in truth if plain_distance(items[j], clean(docs[i])) == 0}
    assert exact <= found
    assert {r["doc_id"] for r in got if r["item_id"] == 79} == {i for i, j in found if j == 0}
    kept = {r["doc_id"] for r in decontaminate.clean_documents(table, bench).collect()}
    assert kept == {*range(300), 900, 901} - {i for i, _ in found}


# -- classifiers


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lang = {r["doc_id"]: r for r in language_id.query(spark, sf).collect()}
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = [i for i in true if lang[i]["held_out"]]
    assert {i for i in true if zlib.crc32(str(i).encode()) % 3 == 1} == set(out)
    assert np.mean([lang[i]["lang_pred"] == true[i] for i in out]) > 0.97
    good = {r["doc_id"]: r for r in quality.query(spark, sf).collect()}
    rows = [r for r in labels.collect() if good[r["doc_id"]]["held_out"]]
    assert np.mean([good[r["doc_id"]]["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in good.values())


def test_classifiers_without_anything_to_learn(spark, make_docs, odd):
    model = language_id.train(make_docs([]))
    assert model is None
    rows = {r["doc_id"]: r for r in language_id.identify(odd, None).collect()}
    assert {r["lang_pred"] for r in rows.values()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = quality.score(odd, quality.train(odd, labels))
    assert scored.count() == len(ODD) + 1 and {r["score"] for r in scored.collect()} == {0.5}
    assert set(odd.columns) == set(scored.columns)


def test_language_of_odd_texts(odd, make_docs):
    learned = make_docs([(i, f"the quick fox {i} runs over" if i % 2 else f"der schnelle Fuchs {i} läuft über") for i in range(60)], lang={i: "en" if i % 2 else "de" for i in range(60)})
    model = language_id.train(learned)
    assert model.languages == ["de", "en"]
    rows = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    for i, t in enumerate(ODD):
        assert (rows[i]["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t)), t


def edited_copies(n, many, seed):
    """Items of n words, and for each a text with a copy at the largest number of edits allowed."""
    rng = random.Random(seed)
    some = lambda k: [f"v{rng.randrange(5000)}" for _ in range(k)]
    items, texts = [some(n) for _ in range(many)], []
    for item in items:
        copy = list(item)
        for _ in range(decontaminate.allowed(n)):
            at, kind = rng.randrange(len(copy)), rng.randrange(3)
            if kind == 0:
                copy[at] = some(1)[0]
            elif kind == 1:
                del copy[at]
            else:
                copy.insert(at, some(1)[0])
        texts.append(some(rng.randrange(50)) + copy + some(rng.randrange(50)))
    return items, texts


@pytest.mark.parametrize("n", [30, 100, 200, 400, 800])
def test_decontamination_recall_of_long_items(n):
    items, texts = edited_copies(n, 40, n)
    index = decontaminate.build_index(list(range(len(items))), [" ".join(i) for i in items])
    got = decontaminate.matches(*_arrow.string_buffer(pa.array([" ".join(t) for t in texts], pa.large_string())), index)
    assert set(got) == {(i, i) for i in range(len(items))}
    assert all(got[i, i][0] == plain_distance(items[i], texts[i]) for i in range(0, len(items), 20))


def test_decontamination_of_an_item_without_id(spark, make_docs):
    text = "one two three four five six seven"
    docs, bench = make_docs([(1, f"so {text} so"), (2, "nothing here")]), spark.createDataFrame([(None, text), (4, "eight nine ten")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, None, 0, 7, 1)]
    assert [r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()] == [2]
