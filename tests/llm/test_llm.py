"""Each training-data operator against brute force, on edge cases and on empty tables."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import (
    components, curriculum, decontaminate, exact_dedup, language, minhash_dedup, quality,
    substring_dedup, token_counts, token_records, url_filter,
)
from spanforge.llm.common import WordHashes

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x) for x in r])


def least(ids):
    return min((i for i in ids if i is not None), default=None)


def test_exact_dedup(docs, rows, nothing):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    want = []
    for r in rows:
        text = SPACE.sub(" ", r[1] or "")
        keep = least(groups[text])
        want.append((r[0], keep, len(groups[text]), r[0] == keep, sha256(text.encode()).hexdigest()))
    assert ordered(exact_dedup.exact_dedup(docs).collect()) == ordered(want)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_substring_dedup(docs, rows, nothing):
    counts, want = Counter(), []
    texts = [words(r[1]) for r in rows]
    for w in texts:
        counts.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    for r, w in zip(rows, texts, strict=True):
        gone = {i + j for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for j in range(35)}
        want.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text", "repeats").collect()
    assert ordered(tuple(r)[:4] for r in got) == ordered(want)
    for r in got:  # maximal: apart from each other, 35 words or more, as many as were removed
        spans = [(s["begin"], s["end"]) for s in r["repeats"]]
        assert sum(e - b for b, e in spans) == r["n_removed"] and all(e - b >= 35 for b, e in spans)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_substring_dedup_inside_one_document(spark):
    rng = random.Random(3)
    part = " ".join(f"w{rng.random()}" for _ in range(40))
    looped = "again " * 100
    docs = spark.createDataFrame([(1, part + " middle " + part), (2, looped)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {1: (80, "middle"), 2: (100, "")}


def near_groups(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    return [(r[0], len(sets[i]), c := least(groups[find(i)]), r[0] == c) for i, r in enumerate(rows)]


def test_minhash_dedup(docs, rows, nothing, monkeypatch):
    got = minhash_dedup.near_duplicates(docs).drop("kid", "kh").collect()
    assert ordered(got) == ordered(near_groups(rows))
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)  # buckets cut into many blocks
    got = minhash_dedup.near_duplicates(docs).drop("kid", "kh").collect()
    assert ordered(got) == ordered(near_groups(rows))
    assert minhash_dedup.near_duplicates(nothing).count() == 0
    kept = minhash_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in near_groups(rows) if r[3]}


def test_signature_guarantee():
    """All signatures within the distance share a bucket key."""
    rng = np.random.default_rng(1)
    most = minhash_dedup.CHUNKS * 2 - 1
    for _ in range(200):
        a = rng.integers(0, 1 << 16, minhash_dedup.SYMBOLS)
        b = a.copy()
        b[rng.choice(len(a), most, replace=False)] += 1
        chunks = (a != b).reshape(minhash_dedup.CHUNKS, -1).sum(1)
        assert chunks.min() <= 1


def test_minhash_of_repeated_rows(spark, monkeypatch):
    """Equal rows are one node and one parsed text, and one of them stays."""
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w7 ", "x ")
    rows = [(1, base, "a"), (1, base, "a"), (1, base, "b"), (2, near, "a"), (2, near, "a"), (3, "", "a"), (3, "", "a"), (4, None, "a"),
            *[(None, text + " q" * 9, "n") for text in (base.upper() + " other", near.replace("w", "v")) for _ in range(6)],
            (None, near.replace("w", "v").replace("v9 ", "z ") + " q" * 9, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    seen, kept_whole = [], minhash_dedup.stored

    def watched(df, name):
        out = kept_whole(df, name)
        if name in ("nodes", "sets"):
            seen.append((name, out.count(), out.select("node").distinct().count()))
        return out

    monkeypatch.setattr(minhash_dedup, "stored", watched)
    got = minhash_dedup.near_duplicates(docs).drop("kid", "kh").collect()
    assert ordered(got) == ordered(near_groups(rows))
    assert [name for name, _, _ in seen] == ["nodes", "sets"] and all(n == distinct for _, n, distinct in seen)
    kept = ordered(minhash_dedup.deduplicated(docs).select("doc_id").collect())
    assert kept == [(None,), (1,), (3,), (4,)]  # one group has no id at all


def test_links_of_far_signatures(spark):
    """A similar pair that shares a bucket is linked, whatever the distance of its signatures."""
    a, b = list(range(80)), list(range(10, 90))
    nodes = [(1, 80, list(range(40))), (2, 80, [*range(4), *range(100, 136)])]
    nodes = spark.createDataFrame(nodes, "node long, n long, symbols array<int>")
    buckets = spark.createDataFrame([(7, 1, 1), (7, 2, 1)], "key long, node long, pivot long")
    sets = spark.createDataFrame([(1, 80, a), (2, 80, b)], "node long, n long, values array<long>")
    assert [tuple(r) for r in minhash_dedup._first_links(buckets, nodes, sets).collect()] == [(2, 1)]


def test_threshold_of_large_sets():
    """One shared shingle too few is no link, where float32 takes both sides for equal."""
    for union in range(3_600_003, 3_700_000, 4):
        both = (3 * union - 1) // 4
        if np.float32(100) * np.float32(both) >= np.float32(75) * np.float32(union):
            break
    own = (union - both) // 2
    sets = [np.arange(own + both, dtype=np.int64), np.arange(own, union, dtype=np.int64)]
    assert 100 * both < 75 * union
    sizes, labels = np.array([len(x) for x in sets]), np.array([1, 2])
    assert minhash_dedup.joining_links(sets, sizes.astype(np.float32), labels) == []
    sets[0] = np.arange(own + both + 1, dtype=np.int64)
    sizes = np.array([len(x) for x in sets])
    assert minhash_dedup.joining_links(sets, sizes, labels) == [(1, 2)]


def test_curriculum_of_sources_without_words(spark):
    """A source whose texts have no word has target 0 and takes nothing, alone or beside others."""
    shape = "doc_id long, text string, source string"
    none = [(1, None, "a"), (2, " ", "a"), (3, "", None)]
    for rows in (none, [*none, (4, "one two three", "b"), (5, "four", "c")]):
        mixed = curriculum.curriculum(spark.createDataFrame(rows, shape))
        got = {r["doc_id"]: tuple(r)[1:] for r in curriculum.document_order(mixed).collect()}
        assert [got[i] for i in (1, 2, 3)] == [(0, 0, 0.0, 0)] * 3
        assert curriculum.training_order(mixed).filter("row.doc_id < 4").count() == 0
        if len(rows) > 3:
            assert got[4][0] == 3 and got[4][3] > 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5)]
    rng.shuffle(links)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def greedy_counter():
    """Greedy longest match over the whole piece list: tokens of a word, and the unknown ones."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_vocabulary())
    pieces = {
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    }
    most = max(map(len, pieces))

    def greedy(word):
        at = tokens = unknown = 0
        while at < len(word):
            end = next((e for e in range(min(len(word), at + most), at, -1) if word[at:e] in pieces), None)
            tokens, unknown, at = tokens + 1, unknown + (end is None), end or at + 1
        return tokens, unknown

    return model, greedy


def test_token_counts(docs, rows, nothing):
    """The low line in front of a word counts as the library counts it."""
    _, greedy = greedy_counter()
    want = []
    for r in rows:
        counts = [greedy("▁" + w) for w in words(r[1])]
        want.append((r[0], len(counts), sum(t for t, _ in counts), sum(u for _, u in counts)))
    assert ordered(token_counts.token_counts(docs).collect()) == ordered(want)
    assert token_counts.token_counts(nothing).count() == 0


def test_automaton_of_random_pieces():
    """Unknown characters inside the automaton, against greedy longest match."""
    rng = random.Random(8)
    for _ in range(300):
        some = lambda: {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(7))}
        first, rest = some(), some()
        automaton = token_counts.Automaton(first, rest)
        for _ in range(40):
            word = "".join(rng.choice("abcd") for _ in range(rng.randrange(12)))
            at = tokens = unknown = 0
            while at < len(word):
                pieces = rest if at else first
                end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
                tokens, unknown, at = tokens + 1, unknown + (end is None), end or at + 1
            assert automaton.counts(word) == tokens + (unknown << token_counts.UNKNOWN)
    begun = time.time()
    strange = token_counts.Automaton(["a" * 2000], ["a" * 2000])
    assert strange.counts("a" * 20000 + "é") == 11 + (1 << token_counts.UNKNOWN)
    assert time.time() - begun < 5


def test_automaton_small():
    automaton = token_counts.Automaton(["a", "abcdx"], ["b", "c", "cdy", "dz"])
    assert [automaton.length(w) for w in ("a", "abcdz", "abcd", "abcdx", "", "b", "abcdyb")] == [1, 4, 0, 1, 0, 0, 4]


def test_token_counts_of_any_first_character(spark):
    """Against greedy longest match over the whole piece list, the low line in front of each word."""
    model, greedy = greedy_counter()
    texts = ["2021", "the 7th of 1999", "ñandú çok ßtraße", "日本語です 你好世界", "한국어 مرحبا שלום Ελλάδα",
             "x\U00013000y \U00013000 日\U00013000\U00013000本 don\U00013000t", "▁a a▁▁b ▁", "2" * 3000]
    want = []
    for i, text in enumerate(texts):
        counts = [greedy("▁" + w) for w in words(text)]
        want.append((i, len(counts), sum(t for t, _ in counts), sum(u for _, u in counts)))
    assert want[0][2:] == (5, 0) == (len(model.encode("2021")), 0) and want[5][3] == 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ordered(token_counts.token_counts(docs).collect()) == want


def test_token_records(spark, docs, rows, nothing, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_records.default_tokenizer())
    at, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    shards = token_records.write_records(docs, str(tmp_path))
    got = token_records.read_records(shards, str(tmp_path)).collect()
    assert ordered(got) == ordered(want)
    shard = shards.orderBy("shard").first()
    picked = token_records.read_indexed(shard["index_path"], shard["records_path"], str(tmp_path), [1, 0])
    assert [p[0] for p in picked] == [want[1][0], want[0][0]] and zlib.crc32(picked[1][1].tobytes()) == want[0][3]
    damaged = bytearray(open(shard["records_path"], "rb").read())
    damaged[-6] ^= 1
    open(shard["records_path"], "wb").write(damaged)
    with pytest.raises(Exception, match="checksum"):
        token_records.read_records(shards, str(tmp_path)).collect()
    assert token_records.record_digests(nothing).count() == 0


def test_checksum_and_special_strings():
    crc = int(token_records.masked_crc32c([b"123456789"])[0])
    crc = (crc - token_records.MASK) & 0xFFFFFFFF
    assert ((crc >> 17) | (crc << 15)) & 0xFFFFFFFF == 0xE3069283  # the published check value
    encoder = token_records.Encoder(token_records.default_tokenizer(), 1)
    texts = ["a<|endoftext|>b <|STARTOFTEXT|>", "Don't. can't!? É́x naïve... 12,5% 's ,", "x" * 5000, "İstanbul ǅ ﬁ"]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, encoder.kind)[:-1].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_inside_words():
    """Words that hold an added token have the ids of the whole text, whatever stands around it."""
    texts = ["<|endoftext|>", "end.<|endoftext|>", "<|startoftext|>,", "a <|endoftext|> b", "x<|startoftext|>Y!?<|endoftext|>...",
             "<|ENDOFTEXT|>", "<|endoftext|", "<|endoftext|>>", "Plain, words."]
    encoder = token_records.Encoder(token_records.default_tokenizer(), 1)
    got = [np.frombuffer(ids, encoder.kind)[:-1].tolist() for ids in encoder.encode([t.encode() for t in texts])]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [49407] and got[1][-1] == 49407 and got[2][0] == 49406


def test_token_records_cut_marks_and_fold_letters_as_the_library_does():
    rng = np.random.default_rng(5)
    pieces = list("aBzÉñßΣσςİıŸЖжё9½²³ªº_'’.,!<|>-—。日本한\u0301\u0338\u200d\u0345\xa0\x1c😀ǅʹͺ") + [
        "'s", "'LL", "E\u0301", "<|endoftext|>", "<|EndOfText|>", " ", "  ", "\n",
    ]
    texts = ["".join(pieces[i] for i in rng.integers(0, len(pieces), rng.integers(0, 12))) for _ in range(4000)]
    encoder = token_records.Encoder(token_records.default_tokenizer(), 1)
    got = [np.frombuffer(ids, encoder.kind)[:-1].tolist() for ids in encoder.encode([t.encode() for t in texts])]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_records_lay_out_long_texts_in_portions(monkeypatch):
    monkeypatch.setattr(token_records, "LAID_OUT", 3)
    monkeypatch.setattr(token_records, "MEMO", 2)
    texts = ["a b c d e f g", "", " ", "h i", "a, B! c"]
    encoder = token_records.Encoder(token_records.default_tokenizer(), 1)
    for _ in range(2):
        got = [np.frombuffer(ids, encoder.kind)[:-1].tolist() for ids in encoder.encode([t.encode() for t in texts])]
        assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.encode([]) == []


def test_curriculum(docs, rows, nothing):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s))
    total, targets, open_ = sum(sizes.values()), {}, set(names)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left = total
    while open_:  # shared out by weight, stopped at three times the size, the rest shared again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        for s in full or open_:
            targets[s] = 3 * sizes[s] if full else weight[s] * level
        left -= sum(targets[s] for s in full)
        open_ = open_ - full if full else set()
    mixed = curriculum.curriculum(docs)
    taken = defaultdict(int)
    for r in mixed.collect():
        own = sum(p["words"] for p in r["passes"])
        assert own <= 3 * r["size"] and all(-1e-9 <= p["position"] <= 1 for p in r["passes"])
        assert r["target"] == pytest.approx(targets[r["row"]["source"]])
        taken[r["row"]["source"]] += own
    assert all(taken[s] == pytest.approx(targets[s], abs=1) for s in names)
    order = curriculum.training_order(mixed).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert sum(r["words"] for r in order) == sum(taken.values())
    assert curriculum.curriculum(nothing).count() == 0


def test_curriculum_rows_in_training_order(spark, tmp_path):
    """op6 gives its rows by the inverted schedules, against brute force by bisection."""
    from hashlib import md5

    rng = random.Random(12)
    rows = [(i, "w " * rng.choice([0, 1, rng.randrange(1, 60)]), rng.choice(["a", "b", "c"])) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in curriculum.op6_curriculum(spark, str(tmp_path)).collect()]
    target = {r[0]: r[3] for r in got}
    places = {}
    for source, slope in zip("abc", curriculum.SLOPES, strict=True):
        own = sorted((r for r in rows if r[2] == source), key=lambda r: md5(str(r[0]).encode()).hexdigest())
        size = sum(len(words(r[1])) for r in own)
        goal, before = int(target[own[0][0]] + 0.5), 0
        for r in own:
            n, at, taken = len(words(r[1])), [], 0
            for k in range(3):
                done = k * size + before
                if (here := max(0, min(n, goal - done))) > 0:
                    low, high = 0.0, 1.0
                    for _ in range(60):  # the integral of the rate, inverted
                        t = (low + high) / 2
                        low, high = (t, high) if ((1 - slope) * t + slope * t * t) * goal < done else (low, t)
                    at.append(round(high, 9))
                    taken += here
            places[r[0]] = ([*at, *[2.0] * (3 - len(at))], r[0], taken)
            before += n
    assert [(r[0], r[4]) for r in got] == [(i, taken) for _, i, taken in sorted(places.values())]


def test_quality(spark, nothing):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = " ".join(f"wor{rng.randrange(999)}" + ("." if rng.random() < 0.1 else "") for _ in range(rng.randrange(30, 90)))
        docs.append((i, text if good else text.upper().replace(" ", "### ")))
        labels.append((i, int(good), 0))
    docs += [(None, None), (9001, None), (9002, ""), (3, docs[3][1])]
    labels += [(5, None, None), (None, 1, 0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    judged = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in judged]) > 0.98
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    kept = quality.accepted(docs, labels)
    assert kept.count() == sum(r["predicted"] for r in got) and kept.columns == docs.columns
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(nothing, labels).count() == 0


def test_language(spark, nothing):
    rng = random.Random(6)
    alphabets = {"aa": "abcdefg", "bb": "hijklmn", "cc": "éèñü"}
    rows = []
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join("".join(rng.choices(alphabets[lang], k=5)) for _ in range(rng.randrange(3, 60))), lang))
    rows += [(900, None, "aa"), (901, "12 34 !", "bb"), (None, "abc defg abc", None), (902, "", None)]
    got = language.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert by_id[900]["lang_pred"] == by_id[901]["lang_pred"] == by_id[902]["lang_pred"] == "und"
    assert np.mean([by_id[i]["lang_pred"] == rows[i][2] for i in range(240) if by_id[i]["held_out"]]) > 0.95
    assert language.languages(nothing).count() == 0


def test_language_of_marks_and_late_passages(spark):
    """Signs that are no letters are no language; long texts teach from all their parts."""
    rows = [(i, "abc abd acb " * 30, "a") for i in range(0, 40)] + [(i, "xyz xzy yxz " * 30, "b") for i in range(40, 80)]
    rows += [(100, "½ ² Ⅷ ①", None), (101, "", None), (102, "½ a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages(df).collect()}
    assert got[100] == ("und", 0.0) == got[101] and got[102][0] in ("a", "b")
    late = spark.createDataFrame([(0, "a" * 9000 + "b" * 9000, "x")], "doc_id long, text string, lang string")
    (lang, part), = language.training_sample(late)
    assert lang == "x" and len(part) == language.SAMPLE_CHARS and set(part) == {ord("a"), ord("b")}


def test_gradients_by_finite_differences():
    """Back-propagation through time against differences of the loss."""
    rng = np.random.default_rng(4)
    k, data = language.HIDDEN, rng.integers(0, 256, (7, 3))
    table, u = rng.normal(0, 0.3, (3 * k, 256)), rng.normal(0, 0.3, (3 * k, k))
    weight = rng.normal(size=(7, k, 3))

    def states(table, u):
        h, out = np.zeros((k, 3)), []
        for column in data:
            both, new = language._gates(table[:, column], u @ h, h)
            h = both[:k] * h + (1 - both[:k]) * new
            out.append(h)
        return np.array(out)

    assert np.allclose(language._states(table, u, data, None), states(table, u), atol=1e-5)
    d_table, d_u = language._backward(table, u, data, states(table, u), weight)
    for x, gradient in ((table, d_table), (u, d_u)):
        some = [(i, data[0, 0]) for i in range(3 * k)] if x is table else [(i, j) for i in range(3 * k) for j in range(2)]
        for place in some:
            kept, loss = x[place], []
            for change in (1e-5, -1e-5):
                x[place] = kept + change
                loss.append((weight * states(table, u)).sum())
            x[place] = kept
            assert abs((loss[0] - loss[1]) / 2e-5 - gradient[place]) < 1e-4


def test_language_pools_every_byte():
    """Pooling by stretches equals labelling each text's stretches alone."""
    net = language.train([("a", b"abcabc" * 40), ("b", b"xyzxyz" * 40)])
    texts = [b"abc" * 100, b"z", b"xyz" * 43, b""]
    for text, p in zip(texts, language.pooled(net, texts), strict=True):
        parts = [text[i : i + language.STRETCH] for i in range(0, len(text), language.STRETCH)]
        alone = sum(language.label_bytes(net, np.frombuffer(x, np.uint8)[:, None])[:, 0] for x in parts) if parts else np.zeros(2)
        assert np.allclose(p, alone / max(1, len(text)), atol=1e-4)


def test_decontaminate(spark, docs, rows, nothing):
    rng = random.Random(8)
    item = [f"q{rng.randrange(500)}" for _ in range(40)]
    other, short = [f"r{rng.randrange(500)}" for _ in range(14)], ["tiny", "item", "here"]
    items = spark.createDataFrame(
        [(1, " ".join(item)), (2, " ".join(other)), (3, " ".join(short)), (4, None), (None, " "), (5, " ".join(item))],
        "item_id long, text string",
    )
    changed = list(item)
    changed[20] = "changed"
    far = list(item)
    for i in range(0, 40, 6):
        far[i] = "far"
    texts = {
        501: "before " * 50 + " ".join(item).upper() + " after" * 30, 502: "x " + " ".join(changed) + " y", 503: " ".join(far),
        504: " ".join(other), 505: "some tiny item here then", 506: " ".join(item[:20]), 507: "tiny item Here",
    }
    more = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    )
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(more, items).collect()}
    assert set(got) == {(501, 1), (501, 5), (502, 1), (502, 5), (504, 2), (505, 3), (507, 3)}
    assert got[501, 1]["start"] == 50 and got[501, 1]["similarity"] == 1
    clean = decontaminate.clean(more, items)
    assert clean.columns == more.columns and clean.count() == more.count() - 5
    assert decontaminate.contaminated(nothing, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_fingerprint_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"w{rng.integers(10**6)}" for _ in range(30)).encode()) for i in range(50)]
    index = decontaminate.Index(items, WordHashes())
    for i in range(50):
        bits = np.unpackbits(index.prints[i])
        bits[rng.choice(128, decontaminate.RADIUS, replace=False)] ^= 1
        assert (0, i) in list(index.candidates(np.packbits(bits)[None], 30))


def test_fingerprint_blocks_turn_unrelated_pairs_away():
    rng = np.random.default_rng(5)
    index = decontaminate.Index([(i, " ".join(f"w{rng.integers(10**6)}" for _ in range(30)).encode()) for i in range(200)], WordHashes())
    windows = decontaminate.fingerprints(rng.integers(0, 2**63, 4000).astype(np.uint64), 26)
    passed = sum(len(w) for w, _, _ in index.passing(windows, 30))
    assert passed <= 0.01 * len(windows) * 200
    assert sum(decontaminate.ERRORS) + len(decontaminate.ERRORS) > decontaminate.RADIUS


def test_decontaminate_against_all_windows():
    """Every window of every text against every item; changed items lie around the threshold."""
    rng, known = random.Random(11), WordHashes()
    items = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 5, 12, 40, 41, 90]))] for _ in range(60)]
    items[7] = ["again", "and"] * 30
    index = decontaminate.Index([(i, " ".join(w).encode()) for i, w in enumerate(items)], known)
    bags = [Counter(zip(*(w[j:] for j in range(min(5, len(w)))))) for w in items]
    found = wanted = 0
    for _ in range(800):
        i = rng.randrange(len(items))
        text = list(items[i])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            text[rng.randrange(len(text))] = f"x{rng.randrange(9)}"
        text = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(30))] + text + ["end"] * rng.randrange(4)
        want = {}
        for k, w in enumerate(items):
            size = min(5, len(w))
            if not bags[k].keys() & set(zip(*(text[j:] for j in range(size)))):
                continue
            for at in range(max(0, len(text) - len(w)) + 1):
                window = text[at : at + len(w)]
                bag = Counter(zip(*(window[j:] for j in range(size))))
                likeness = (bag & bags[k]).total() / (bag | bags[k]).total()
                if likeness >= 0.75 and likeness > want.get(k, (0, 0))[0]:
                    want[k] = (likeness, at)
        got = index.matches(known.of([w.encode() for w in text]))
        assert set(got) <= set(want)
        wanted += len(want)
        found += sum(got.get(k) == v for k, v in want.items())
    assert wanted > 200 and found >= 0.99 * wanted


def test_decontaminate_repetitive_text_takes_seconds():
    words = [f"r{k}" for k in range(5)]
    items = [(n, " ".join((words * 40)[: 20 + n % 60] + [f"i{n}"]).encode()) for n in range(2000)]
    known = WordHashes()
    index = decontaminate.Index(items, known)
    begun = time.monotonic()
    got = index.matches(known.of([w.encode() for w in words * 20_000]))
    assert time.monotonic() - begun < 20
    assert set(got) == set(range(2000)) and all(start < 5 for _, start in got.values())


def test_url_filter(spark):
    urls = [None, "", "nohost", "http://Example.COM/en/a?x", "https://www.example.com/en/", "http://a.net/es/1#t",
            "http://net/fr/", "http://notcom/en/", "http://example.com", "ftp://x.org/p?q#r", "http://a.b.com?/en/",
            "http://m.www.example.com/en/z", "http://example.net/es"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(0, None, "h"), (9, urls[9], "h")]
    rows += [(100 + i, f"http://good{i % 7}.com/read/{i}", "h") for i in range(80)]
    rows += [(200 + i, f"http://spam{i % 7}.net/fr/{i}", "h") for i in range(80)]
    rows += [(300, "http://spam3.org/fr/9", "h"), (301, "http://good2.org/read/7", "h")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"))
    found = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    want = {
        0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("example.com", "/en/a", "example.com/en/"),
        4: ("www.example.com", "/en/", "www.example.com/en/"), 5: ("a.net", "/es/1", "net/es/"),
        6: ("net", "/fr/", "net/fr/"), 7: ("notcom", "/en/", None), 8: ("example.com", "", None),
        9: ("x.org", "/p", None), 10: ("a.b.com", "", None), 11: ("m.www.example.com", "/en/z", "www.example.com/en/"),
        12: ("example.net", "/es", None),
    }
    assert {i: (found[i]["host"], found[i]["path"], found[i]["rule"]) for i in want} == want
    assert found[3]["verdict"] == "block" and found[4]["verdict"] == found[11]["verdict"] == "allow"
    assert found[300]["verdict"] == "block" and found[301]["verdict"] == "allow"
    assert all(r["verdict"] in ("allow", "block") for r in found.values())
    empty = url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"))
    assert empty.count() == 0


@pytest.mark.parametrize("hot", [f"http://spam.net/fr/win{c}" for c in "ab"])
def test_url_filter_with_one_blocked_url(spark, hot):
    """One hot blocked url, in the calibrating fifth or not, still teaches the model."""
    rows = [(i, hot) for i in range(60)] + [(100 + i, f"http://good{i % 7}.com/read/{i}") for i in range(60)]
    rows += [(300, hot.replace(".net", ".org")), (301, "http://good2.org/read/7")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"))
    found = {r["page_id"]: r["verdict"] for r in got.filter("page_id >= 300").collect()}
    assert found == {300: "block", 301: "allow"}


def test_url_weights_against_brute_force(spark):
    """The tables give Witten and Bell's interpolation of all orders."""
    rng = random.Random(1)
    grams = [("".join(rng.choices("ab.", k=4)), rng.randrange(3), rng.randrange(3)) for _ in range(60)]
    grams = list({g: (g, a, b) for g, a, b in grams}.values())
    got = {r["gram"]: r["weight"] for r in url_filter._weights(spark.createDataFrame(grams, "gram string, allow long, block long")).collect()}
    for gram, _, _ in grams:
        logs = []
        for k in (1, 2):
            p = 1 / url_filter.ALPHABET
            for order in range(4):
                seen = Counter()
                for g in grams:
                    if g[0][3 - order : 3] == gram[3 - order : 3]:
                        seen[g[0][3]] += g[k]
                n, t = sum(seen.values()), sum(1 for c in seen.values() if c)
                p = (seen[gram[3]] + t * p) / (n + t) if n else p
            logs.append(np.log(p))
        assert got[gram] == pytest.approx(logs[0] - logs[1])


def test_pipeline_on_edge_rows(spark, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "tiny item here now please")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(20, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights",
        "token-ID / binary output",
    ]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns
    want = [r["doc_id"] for r in kept.collect()]
    assert len(want) > 10
    got = sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == want
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    plain = ordered(r[2:] for r in token_records.record_digests(kept).collect())
    assert ordered(r[2:] for r in got) == plain


def test_reading_order_is_that_of_the_files(spark, tmp_path):
    rng = random.Random(4)
    ids = rng.sample(range(10_000), 3000)
    df = spark.createDataFrame([(k, i, f"text {i}") for k, i in enumerate(ids)], "place long, doc_id long, text string")
    df.repartitionByRange(7, "place").sortWithinPartitions("place").drop("place").write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    got = token_records.record_digests(back, order=token_records.reading_order()).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == ids
