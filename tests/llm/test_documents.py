"""Document operators against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe, contamination, lattice, licenses, minhash, quality, token_files
from tessella.llm.shared import new_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def near_groups(rows):
    """Brute force: component by id."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(docs_of):
    rng = random.Random(5)
    rows = []
    for base in range(12):
        text = prose(rng, rng.choice([3, 12, 60, 200])).split()
        for _ in range(8):
            copy = [rng.choice(VOCABULARY) if rng.random() < 0.012 else w for w in text]
            rows.append((len(rows) * 7 % 97, " ".join(copy)))
    passage = prose(rng, 60)
    rows += [(200 + i, prose(rng, 40) + " " + passage) for i in range(15)] + [(300, rows[0][1].upper()), (301, None), (302, "")]
    rows = list(dict(rows).items())
    for p in (minhash.MinMaxParams(), minhash.MinMaxParams(block=2)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(rows), p).collect()}
        assert got == near_groups(rows)


def test_near_duplicates_alike_but_apart(docs_of, monkeypatch):
    """Copies of one text that are alike but mostly no links: only links leave the join inside buckets."""
    rng, made, confirmed = random.Random(11), [], minhash._confirmed
    text = prose(rng, 150).split()
    rows = [(i, " ".join(rng.choice(VOCABULARY) if rng.random() < 0.035 else w for w in text)) for i in range(90)]

    def counted(likely, bodies, p):
        made.append((likely.count(), confirmed(likely, bodies, p)))
        return made[-1][1]

    monkeypatch.setattr(minhash, "_confirmed", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(rows)).collect()}
    assert got == near_groups(rows)
    likely, links = made[1]
    assert likely == links.count()


def test_near_duplicates_odd(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[5]["component_id"] == 4 and not by[5]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert minhash.near_duplicates(none).count() == 0


def test_tokens_round_trip(spark, docs_of, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    rows = [(i, prose(rng, 30) + " <|endoftext|> It's\n\n  x") for i in rng.sample(range(500), 60)]
    for df in (docs_of(rows), odd):
        where = new_path(spark, "test")
        token_files.write_tokens(df, path, where, parts=3)
        got = sorted(token_files.read_tokens(spark, where).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is not None, x))
        texts = {}
        for r in df.collect():
            texts.setdefault(r["doc_id"], []).append(r["text"] or "")
        at = 0
        for r in got:
            ids = library.encode(texts[r["doc_id"]].pop(0), add_special_tokens=False).ids + [0]
            assert (r["start"], r["n_tokens"], list(r["ids"])) == (at, len(ids), ids)
            at += len(ids)
        sums = {r["start"]: r["ids_crc32"] for r in token_files.with_crc32(token_files.read_tokens(spark, where)).collect()}
        assert all(sums[r["start"]] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in got)
    where = new_path(spark, "test")
    token_files.write_tokens(none, path, where)
    assert token_files.read_index(spark, where).count() == 0


def test_bpe_equals_library(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = bpe.digests(odd, path).collect()
    assert len(got) == odd.count() and bpe.digests(none, path).count() == 0
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("text", ["It's DON'T we'LL", "ΣΑΣ İ ǅ ﬁ①", "<|endoftext|>a<|startoftext|>", "日本語 🙂👩‍👩‍👧", "123 ４５ Ⅳ½", "___--!!", "x" * 500, "K Å ẛ̣"])
def test_bpe_strings(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, ids = bpe.codec(path), Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert list(np.frombuffer(own.encode(text), "<u4")) == ids
    assert own.text(own.encode("the cat sat")).strip() == "the cat sat"


def test_bpe_long_words():
    """The heap gives the ids of the scan, and of the library, and a long word is no square."""
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library, rng = bpe.codec(path), Tokenizer.from_file(path), random.Random(3)
    for letters in ("ab", "aehinrst", "日本語の文", "é🙂x"):
        for n in (1, 2, 3, 30, 65, 300):
            word = "".join(rng.choice(letters) for _ in range(n))
            data = word.encode()
            parts = [own.first[b] for b in data[:-1]] + [own.last[data[-1]]]
            assert own._scanned(parts[:]) == own._heaped(parts[:])
            assert list(np.frombuffer(own.encode(word), "<u4")) == library.encode(word, add_special_tokens=False).ids
    word = "".join(rng.choice("日本語の文章") for _ in range(60_000))
    assert list(np.frombuffer(own.encode(word), "<u4")) == library.encode(word, add_special_tokens=False).ids
    assert word not in own.known


def test_base_scores(docs_of, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(4)
    rows = [(i, prose(rng, 20) + (" Rare%d" % i)) for i in range(60)] + [(99, None)]
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((t or "").translate(LOWER).split() + [None])
    total, distinct = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lattice.score_texts(docs_of(rows), path, frequent=50).collect()}
    for i, t in rows:
        w = (t or "").translate(LOWER).split() + [None]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(sum(log10((counts[x] + 1) / (total + distinct + 1)) for x in w))
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and r["score"] < 0
    assert lattice.score_texts(odd, path).count() == odd.count()
    assert lattice.score_texts(none, path).count() == 0


def test_base_scores_of_odd_rows(docs_of, odd):
    """Repeated and null ids are scored each by itself; the texts of clashing columns don't matter."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = sorted((r["doc_id"] or 0, r["n_tokens"], round(r["score"], 6)) for r in lattice.score_texts(odd, path, frequent=3).collect())
    alone = {}
    for r in lattice.score_texts(odd, path).collect():
        alone.setdefault((r["doc_id"] or 0, r["n_tokens"]), []).append(round(r["score"], 6))
    assert sorted((i, n, s) for (i, n), scores in alone.items() for s in scores) == got
    assert [x[1] for x in got] == [9, 1, 1, 1, 2, 2, 9, 9, 30001, 5]


def test_words_of_every_block(monkeypatch):
    """Blocks inside a batch, and batches inside others, count the words of a plain loop."""
    rng = random.Random(7)
    texts = [rng.choice([" ", "\n"]).join("".join(rng.choice("aBéß日🙂-") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(40))) for _ in range(300)]
    want = Counter(w for t in texts for w in t.encode().lower().split())
    whole = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([i % 3 > 0 for i in range(300)]), pa.array(texts)], names=["a", "b", "c"])
    monkeypatch.setattr(lattice, "blocks", lambda texts, rows, size: ((k, min(37, len(texts) - k)) for k in range(0, len(texts), 37)))
    for batch in (whole, pa.RecordBatch.from_arrays([c.slice(0) for c in whole.columns], names=["a", "b", "c"]).slice(0, 300)):
        got, learned = Counter(), Counter()
        for out in lattice._word_counts([batch.slice(0, 120), batch.slice(120)]):
            for w, c, n in zip(*(x.to_pylist() for x in out.columns), strict=True):
                got[w] += n
                learned[w] += c
        assert got == want
        assert learned == Counter(w for i, t in enumerate(texts) if i % 3 > 0 for w in t.encode().lower().split())


def own_uses(words):
    """Brute force: pieces of the vocabulary's own segmentation."""
    model = lattice.processor(public_tokenizers.path("piece_bpe_32k.model"))
    return Counter(i for w, c in words.items() for i in model.encode(w) * c)


def all_ways(own, text):
    """Brute force: the summed probability of all segmentations, by enumeration."""
    if not text:
        return 1.0
    total = np.exp(sum(own.bytes[b] for b in text[0].encode())) * all_ways(own, text[1:])
    return total + sum(np.exp(own.logs[text[:k]]) * all_ways(own, text[k:]) for k in range(1, len(text) + 1) if text[:k] in own.logs)


def test_lattice_sums_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    for own in (lattice.Lattice(path), lattice.Lattice(path, own_uses({"the": 5, "banana": 2, "é~": 1}), 7)):
        assert np.exp(own.bytes).sum() + sum(map(np.exp, own.logs.values())) + np.exp(own.end) == pytest.approx(1)
        for word in ("the", "banana", "other", "z", "zqj", "é~", "日本", "🙂a", "▁x"):
            assert own.word(word) == pytest.approx(np.log(all_ways(own, "▁" + word)), rel=1e-12)


def test_words_side_by_side_equal_one_by_one():
    rng = random.Random(12)
    letters = "abcdeéßñ日🙂▁-'.0"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(70))) for _ in range(800)] + ["the", "information", "x" * 47, "x" * 48, "x" * 5000]
    own = lattice.Lattice(public_tokenizers.path("piece_bpe_32k.model"), own_uses({"the": 5, "information": 2}), 3)
    assert own.words(words) == pytest.approx([own.word(w) for w in words], rel=1e-12)


def test_scores_of_documents_by_enumeration(docs_of):
    """Whole documents: pieces counted from training rows, then every segmentation written out."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, t) for i, t in enumerate(["The cat", "a cat sat", "", None, "the end", "Cat cat\tthe", "dog", "a dog ran", "it ran", "ran"])]
    train = [(t or "").lower().split() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    own = lattice.Lattice(path, own_uses(Counter(w for t in train for w in t)), len(train))
    got = {r["doc_id"]: r for r in lattice.score_texts(docs_of(rows), path, frequent=2).collect()}
    assert any(r["held_out"] for r in got.values())
    counts, total = Counter(w for t in train for w in t), sum(map(len, train)) + len(train)
    share = sum(c == 1 for c in counts.values()) / total
    for i, t in rows:
        logs = [np.log(all_ways(own, "▁" + w)) for w in (t or "").lower().split()]
        assert got[i]["score"] == pytest.approx((sum(logs) + own.end) / np.log(10), rel=1e-9)
        mixed = sum(np.log((1 - share) * counts[w] / total + share * np.exp(x)) for w, x in zip((t or "").lower().split(), logs, strict=True))
        assert got[i]["mixed_score"] == pytest.approx((mixed + np.log((1 - share) * len(train) / total)) / np.log(10), rel=1e-9)


def test_long_unseen_word_has_no_floor(docs_of):
    path = public_tokenizers.path("piece_bpe_32k.model")
    learned = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2)
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    word = "é日q7/" * 2000
    got = {r["doc_id"]: r["score"] for r in lattice.score_texts(docs_of([(learned, "the cat the end cat once"), (held, word)]), path).collect()}
    own = lattice.Lattice(path, own_uses({"the": 2, "cat": 2, "end": 1, "once": 1}), 1)
    assert got[held] == pytest.approx((own.word(word) + own.end) / np.log(10)) and got[held] < -5000


def brute_hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    words, hit, found = find(text), set(), set()
    for i, t in items:
        w = find(t)
        for s in range(max(len(w) - 9, 1) if w else 0):
            window = w[s : s + 10]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    found.add(str(i))
    return len(words), len(hit), sorted(found)


def test_contamination(spark, docs_of, odd, none):
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 2, 3, 9, 10, 14, 30, 30])] + [(50, None), (51, "!!"), (52, "É " + prose(rng, 11)), (53, "the the the the the the the the the the the")]
    rows = []
    for i in range(40):
        text = prose(rng, 40).split()
        if i % 2:
            cut = (rng.choice(items)[1] or "").split()
            text[7:7] = cut[rng.randrange(3) :]
        rows.append((i, rng.choice([", ", " ", "\n"]).join(text).upper() if i % 3 == 0 else " ".join(text)))
    rows += [(90, "the " * 25), (91, None), (92, "é " + items[-2][1][2:])]
    table = spark.createDataFrame(items, "item_id long, text string")
    for shingle, bound in ((3, 10**6), (2, 10**6), (3, 0)):  # a bound of 0: no side is broadcast
        got = contamination.contaminated(docs_of(rows), table, shingle=shingle, broadcast_windows=bound, broadcast_places=bound).collect()
        got = {r["doc_id"]: r for r in got}
        for i, t in rows:
            n, hit, found = brute_hits(t, items)
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0), (i, t)
            assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert contamination.contaminated(odd, table).count() == odd.count()
    assert contamination.contaminated(none, table).count() == 0 and contamination.contaminated(odd, table.limit(0)).where("contaminated").count() == 0
    kept = contamination.without_contaminated(odd, spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string"))
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 8]


def test_contamination_by_text_not_by_id(docs_of, spark):
    """Null ids are judged; rows that share an id are not one document; copies are each hit."""
    rows = [(None, "a b c d e"), (None, "x y"), (6, "a b c d e"), (6, "x"), (7, "p q a b c d e"), (7, "p q a b c d e")]
    table = spark.createDataFrame([(1, "A, b c-d e"), (2, "b c d"), (None, "q a"), (3, "y z")], "item_id long, text string")
    for bound in (10**6, 0):
        got = contamination.contaminated(docs_of(rows), table, broadcast_windows=bound, broadcast_places=bound)
        got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect()))
        assert got == [(0, 2, 0, 0), (0, 5, 5, 2), (6, 1, 0, 0), (6, 5, 5, 2), (7, 7, 6, 2), (7, 7, 6, 2)]
    kept = contamination.without_contaminated(docs_of(rows), table)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "x y"), (6, "x")]


def test_license_scan(docs_of, odd, none):
    texts = {
        1: "x GNU General Public License, version 3 or later y", 2: "Licensed under the Apache License, Version 2.0.", 3: "CC-BY-NC 4.0 and cc by",
        4: "MIT License. mit-license; MIT\nLicense", 5: "apache licenses", 6: None, 7: "the occ bye", 8: "SPDX-License-Identifier: GPL-2.0-only", 9: "apache apache license license",
    }
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(texts.items())).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(p, v) for phrase, v in licenses.BASE.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at)), i
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None)), i
        assert r["base_labels"] == ",".join(sorted({v for _, v in at})) and {v for _, v in at} <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1
    assert "gpl-3.0-or-later" in got[1]["labels"] or "gpl-3-or-later" in got[1]["labels"]
    assert "apache-2.0" in got[2]["labels"] and "cc-by-nc-4.0" in got[3]["labels"] and got[5]["n_base"] == 0
    assert got[8]["labels"] == "gpl-2-0-only" and got[7]["labels"] == ""
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0
    assert len(licenses.rules()) > 200


def written_out(parsed):
    """The shortest texts of an expression, one for each choice of alternatives and optional parts."""
    texts = [""]
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                more = [chr(arg)]
            case "BRANCH":
                more = [t for x in arg[1] for t in written_out(x)]
            case "SUBPATTERN":
                more = written_out(arg[-1])
            case "MAX_REPEAT":
                once = written_out(arg[2])
                more = ([""] if arg[0] == 0 else []) + once
            case "IN":
                more = [chr(x) for kind, x in arg if str(kind) == "LITERAL"] or ["x"]
        texts = [a + b for a in texts for b in more]
    return texts


def test_license_words_in_every_alternative():
    for _, needed, expression, *_ in licenses.rules():
        for text in written_out(re._parser.parse(expression)):
            assert re.fullmatch(expression, text) and {*needed.split()} <= {*text.split()}, (needed, text)


def detections(text):
    """Brute force: all rules on the words, then suppression pair by pair."""
    j = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) + " "
    hits = [(m.start(), m.end(), prio, i, label, conf) for i, _, e, label, prio, conf in licenses.rules() for m in re.finditer(" " + e + "(?= )", j)]
    order = sorted(hits, key=lambda h: (h[0], -h[1], -h[2], h[3]))
    kept = [h for n, h in enumerate(order) if not any(o[1] >= h[1] and o[2] >= h[2] for o in order[:n])]
    base = {v for p, v in licenses.BASE.items() if f" {p} " in j}
    return ",".join(sorted({h[4] for h in kept} | base)), max([h[5] for h in kept] + [0.75] * bool(base) + [0.0])


def test_license_labels_against_all_rules(docs_of):
    rng = random.Random(9)
    sentences = [rng.choice(written_out(re._parser.parse(e))) for _, _, e, *_ in licenses.rules()]
    texts = [" ".join(rng.choice(sentences) if rng.random() < 0.4 else prose(rng, 3) for _ in range(rng.randrange(12))) for _ in range(150)]
    texts += sentences + ["mit license " * 3000, None, "permit the occ bye licenses"]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs_of(enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == detections(t), t


def test_license_full_name_without_short(docs_of):
    name = "Common Development and Distribution License"
    texts = {1: f"Under the {name} 1.0", 2: f"licensed under {name}, version 1.1.", 3: f"the {name}", 4: "CDDL 1.1", 5: f"{name} (CDDL) 1.0"}
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs_of(texts.items())).collect()}
    assert got == {1: "cddl-1.0", 2: "cddl-1.1", 3: "cddl", 4: "cddl-1.1", 5: "cddl,cddl-1.0"}


def test_quality(spark, docs_of, odd, none):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(5, 80)) if i % 3 else " ".join(w + "###" for w in prose(rng, 30).split())) for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(500)], "doc_id long, quality int, toxic int")
    p = quality.NetParams(epochs=4)
    out = quality.classify(docs_of(rows), labels, p=p).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 500 and np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    net = quality.fit(docs_of(rows), labels, p)
    assert quality.score(odd, net, p).count() == odd.count() and quality.score(none, net, p).count() == 0
    assert quality.fit(none, labels.limit(0), p).shift == 0


def slow_probability(text, net, p):
    """Brute force: every filter at every byte, pooled over the strips of every chunk."""
    data = list(text) + [0] * (p.width - len(text))
    step, strips = p.chunk - p.width + 1, []
    for k in range(0, max(1, len(data) - p.width + 1), step):
        chunk = data[k : k + p.chunk]
        places = [[sum(net.table[o][chunk[i + o]][f] for o in range(p.width)) for f in range(p.filters)] for i in range(len(chunk) - p.width + 1)]
        strips += [[max(max(x[f] for x in places[a : a + p.strip]) + net.bias[f], 0.0) for f in range(p.filters)] for a in range(0, len(places), p.strip)]
    features = [max(s[f] for s in strips) for f in range(p.filters)] + [sum(s[f] for s in strips) / len(strips) for f in range(p.filters)]
    return 1 / (1 + np.exp(-np.clip(sum(a * b for a, b in zip(features, net.out)) + net.shift, -30, 30)))


def test_quality_equals_a_slow_forward_pass(odd):
    p = quality.NetParams(filters=3, chunk=64, strip=16)
    rng = np.random.default_rng(5)
    net = quality.Net(rng.normal(0, 0.3, (p.width, 256, 3)).astype(np.float32), rng.normal(0, 0.3, 3).astype(np.float32), rng.normal(0, 0.3, 6).astype(np.float32), 0.1)
    texts = [b"", b"a", b"abcd", b"abcde", rng.bytes(63), rng.bytes(64), rng.bytes(65), rng.bytes(124), rng.bytes(125), rng.bytes(1000), b"\0" * 70]
    for t in texts:
        assert quality.probability(t, net, p) == pytest.approx(slow_probability(t, net, p), abs=1e-5)
    scored = odd.join(odd.limit(0), "doc_id", "left_anti")
    for r in quality.score(scored.where("doc_id <> 7 or doc_id is null"), net, p, into="own").collect():
        assert r["own"] == pytest.approx(slow_probability((r["text"] or "").encode(), net, p), abs=1e-5)
    with pytest.raises(ValueError, match="already"):
        quality.score(odd, net, p, into="Score")


def test_quality_pieces_are_bounded_and_reach_the_end():
    p = quality.NetParams()
    text = bytes(range(256)) * 4000
    found = quality.pieces(text, p)
    assert len(found) == p.epochs and all(len(x) == p.piece and x in text for x in found)
    assert quality.pieces(b"abc", p) == [b"abc"] and quality.pieces(text, p) == found


def test_quality_sees_the_end_of_a_text():
    p = quality.NetParams(epochs=4)
    net = quality.train([b"abc def " * 20, b"### $$$ " * 20] * 20, [1, 0] * 20, p=p)
    long = b"abc def " * 4000
    assert quality.probability(long + b"### $$$ " * 400, net, p) < quality.probability(long, net, p)
