"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import bpe, chat, components, decontaminate, jaccard_join, licenses, neighbours, passages, piece_table, token_files, toxicity, urls, words
from tessella.llm.queries import PHRASES, RULES, tokenizer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "  a  b ", "É Ünïcode 漢字 🙂\x00\x1c\u3000x", "<|endoftext|> a <|endoftext|>b", "it's we'll I'M 12345", "\n\n a\n b", "x" * 5000, "One two"]


def lower(text):
    return (text or "").translate(UPPER)


def frame(spark, texts, ids=None):
    """Documents with columns whose names could clash with an operator's own."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "x", 1, [1], -1) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, start long, hits array<int>, h long").repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


def test_words_and_hashes_do_not_depend_on_neighbours():
    texts = [x or "" for x in ODD] + ["a" * 400_000, "b c"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    for kind, pattern in ((words.ALNUM, WORD), (words.VISIBLE, VISIBLE)):
        all_ = words.Words(data, offsets, kind)
        h = all_.hashes
        for i, text in enumerate(texts):
            a, b = all_.first[i], all_.first[i + 1]
            found = [all_.low[s:e].tobytes().decode() for s, e in zip(all_.starts[a:b], all_.ends[a:b], strict=True)]
            assert found == pattern.findall(lower(text))
            own = words.Words(np.frombuffer(raw[i], np.uint8), np.array([0, len(raw[i])]), kind)
            assert np.array_equal(own.hashes, h[a:b])
    assert len(words.shingles(h[:2], 5)) == 1 and len(words.shingles(h[:0], 5)) == 0


def test_bpe_is_the_library_and_decodes_back(spark, library):
    rng = random.Random(1)
    alphabet = " \n\tabcdeÉß'’stl1234½²漢🙂\x1c\u3000.,!?-_\r\x00\u0301"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)] + ["<|endoftext|>" * 3, "aaaa" * 300]
    out = by_id(bpe.encode_decode(frame(spark, texts), tokenizer()))
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(frame(spark, []), tokenizer()).count() == 0


def pieced(table, texts):
    data = [x.encode() for x in texts]
    offsets = np.append(0, np.cumsum([len(x) for x in data]))
    columns = table.texts(np.frombuffer(b"".join(data), np.uint8), offsets)
    return [[v[at[i] : at[i + 1]] for v, at in columns] for i in range(len(texts))]


@pytest.mark.parametrize("case", ["plain", "forgets", "equal hashes", "small blocks"])
def test_pieces_give_what_whole_texts_give(monkeypatch, library, case):
    if case == "forgets":
        monkeypatch.setattr(piece_table, "REMEMBERED", 50)
    if case == "equal hashes":
        real = piece_table.piece_hashes
        monkeypatch.setattr(piece_table, "piece_hashes", lambda data, starts: real(data, starts) & np.uint64(255))
    for module in (bpe, token_files) if case == "small blocks" else ():
        monkeypatch.setattr(module, "BLOCK", 7)
    rng = random.Random(case)
    signs = ["a", "B", "é", "×", "·", " ", " ", " ", "  ", ".", ",", "!?", "'s", "1", "漢", "я", "\n", "\t", "<|endoftext|>", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "…", "🙂", "ß", "Ž", "_", "\x00"]
    texts = ["", *["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(1500)], ""]
    encoder, coder = bpe.PieceEncoder(tokenizer()), token_files.Coder(tokenizer())
    for some in (texts[:700], texts[600:], []):
        for text, (ids, raw), (numbers,) in zip(some, pieced(encoder, some), pieced(coder, some), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert numbers.tolist() == want
            assert ids.tobytes().decode() == "".join(f"{i}," for i in want)
            assert raw.tobytes().decode() == text


def test_token_files(spark, library, tmp_path):
    texts = ODD + ["again", "again"]
    ids = [7, 3, -5, *range(100, 100 + len(texts) - 3)]
    folder = f"file://{tmp_path}/corpus"
    out = by_id(token_files.token_files(frame(spark, texts, ids), tokenizer(), 0, folder))
    start = 0
    for i, text in sorted(zip(ids, texts, strict=True)):
        own = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert sum(p.stat().st_size for p in (tmp_path / "corpus").glob("*.bin")) == 2 * start
    assert token_files.token_files(frame(spark, []), tokenizer()).count() == 0
    assert sorted(p.name.partition(".")[2] for p in (tmp_path / "corpus").iterdir()).count("json") == 1
    assert not [p.name for p in (tmp_path / "corpus").iterdir() if not re.fullmatch(r"[0-9]+\.(bin|idx)|manifest.json", p.name)]
    assert len(token_files.read_files(spark, folder).collect()) == len(texts)


def test_token_files_of_ties_and_null_ids(spark, library):
    ids, texts = [5, None, 5, 4, 5, None, 5], ["b c", "x", "a", "z", None, None, "a"]
    for seed in (1, 2):
        got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.token_files(frame(spark, texts, ids).repartition(seed), tokenizer()).collect()))
        want, start = [], 0
        for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
            own = [*library.encode(t or "", add_special_tokens=False).ids, 0]
            want.append((start, i, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
            start += len(own)
        assert got == want


def test_license_scan(spark):
    texts = ODD + ["Under the MIT\nLicense. x, under the mit license", "under the under the MIT license under the mit license", "Apache License, Version 2.0", "CC BY-NC 4.0; cc by nc", "transmit license", "GNU General Public License, version 3.", "All rights reserved."]
    out = by_id(licenses.license_scan(frame(spark, texts), PHRASES))
    for i, text in enumerate(texts):
        own, at, labels = WORD.findall(lower(text)), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            here = [k for k in range(len(own)) if own[k : k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(own), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert out[len(texts) - 2].labels == "gpl-3" and out[len(texts) - 1].labels == "proprietary"
    assert len(licenses.RULES) > 200 and licenses.license_scan(frame(spark, []), PHRASES).count() == 0


def test_license_rules_are_suppressed_by_priority():
    text = b" this work is licensed under the gnu general public license version 3 or the mit license "
    kept = licenses.detect(text)
    assert [r.label for *_, r in kept] == ["gpl-3", "gpl-3", "mit"]  # "this work is ..." reaches further than "licensed under ..."
    assert all(not (s2 <= s and e <= e2 and r.priority < r2.priority) for s, e, r in kept for s2, e2, r2 in kept)
    assert [r.label for *_, r in licenses.detect(b" mit license gpl ")] == ["mit", "gpl"]  # a shared word hides neither
    for said, label in [("spdx license identifier bsd 3 clause", "bsd-3-clause"), ("cc0 1 0 universal", "cc0"), ("see gpl v3", "gpl-3"), ("eupl v 1 2", "eupl"), ("the wtfpl", "wtfpl"), ("ms pl license", "ms-pl"), ("placed in the public domain", "public-domain"), ("gnu free documentation license", "gfdl"), ("odc by", "odc-by")]:
        assert [r.label for *_, r in licenses.detect(f" {said} ".encode())] == [label]


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(1, prose(rng, 30)), (2, "w1x w2x w3x"), (10, ""), (11, None), (None, "w1x"), (12, prose(rng, 10))]
    leak = " ".join(items[0][1].split()[5:22])
    texts = ODD + [prose(rng, 50) + ", " + leak.upper() + " " + prose(rng, 9), "W1x w2X. w3x w1x w2x w3x", leak[:-1], items[5][1]] + [prose(rng, 300) for _ in range(20)] + ["w1x w2x", "w3x"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = by_id(decontaminate.contamination(frame(spark, texts), bench))
    for i, text in enumerate(texts):
        own, hit, found = WORD.findall(lower(text)), set(), set()
        for item, phrase in items:
            p = WORD.findall(lower(phrase))
            size = min(10, len(p))
            for k in range(len(p) - size + 1 if size and item is not None else 0):
                for s in range(len(own) - size + 1):
                    if own[s : s + size] == p[k : k + size]:
                        hit |= set(range(s, s + size))
                        found.add(str(item))
        r = out[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(own), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert {w for h in r.hits for w in range(h.start, h.end)} == hit
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0
    assert decontaminate.contamination(frame(spark, ["a b"]), bench.limit(0)).first().n_items == 0


def test_phrase_blocks_and_proximity(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    bench = spark.createDataFrame([(i, f"p{i} q{i} r{i}") for i in range(5)], "item_id long, text string")
    out = decontaminate.contamination(frame(spark, ["p1 q1 r1 p3 q3 r3 z"]), bench).first()
    assert (out.n_items, out.n_hit) == (2, 6)
    index = decontaminate.build_index(frame(spark, ["a x x b", "b a", "a x x x x b", "a"]).select("doc_id", "text"), 10)
    near = decontaminate.proximity(index, ["a b", "none"], 3, 10)
    assert sorted((r.doc_id, r.places) for r in near.collect()) == [(0, 1), (1, 1)]


def test_postings_pack():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 5])
    assert decontaminate.unpack(np.frombuffer(decontaminate.pack(values), np.uint8)).tolist() == values.tolist()


def brute_groups(texts, percent, k):
    sets = []
    for t in texts:
        w = VISIBLE.findall(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("percent", "k"), [(90, 3), (80, 5)])
def test_jaccard_groups(spark, percent, k, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)  # many blocks
    rng = random.Random(percent)
    texts = ODD + ["One two", "ONE  two"]
    for n in (3, 8, 9, 10, 11, 12, 13, 14, 20, 22, 24, 40, 60, 150):
        for _ in range(2):
            base = prose(rng, n, 5000).split()
            for _ in range(7):
                copy = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                    if rng.random() < 0.5:
                        copy[rng.randrange(len(copy))] = f"n{rng.random()}"
                    else:
                        copy = copy[:-1] or copy
                texts.append(" ".join(copy))
    out = by_id(jaccard_join.jaccard_groups(frame(spark, texts), percent, k, words.VISIBLE, counters=1 << 16))
    expected = brute_groups(texts, percent, k)
    assert {i: (r.n_shingles, r.component_id) for i, r in out.items()} == expected
    assert len({c for _, c in expected.values()}) < len(texts) - 50
    assert jaccard_join.jaccard_groups(frame(spark, []), percent, k, words.VISIBLE, counters=1 << 16).count() == 0
    assert {r.component_id for r in jaccard_join.jaccard_groups(frame(spark, ["a b c d"] * 3, [5, None, 4]), percent, k, words.VISIBLE, counters=1 << 16).collect()} == {4, None}


def test_light_sets_that_link_meet():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for s in (4, 5, 9, 10, 11, 19, 20):
            a = words.distinct(rng.integers(0, 2**63, s, dtype=np.uint64))
            for t in jaccard_join.partners(s, percent):
                for shared in range(max(0, min(s, t) - 2), min(s, t) + 1):
                    b = words.distinct(np.concatenate([a[:shared], rng.integers(0, 2**63, t - shared, dtype=np.uint64)]))
                    meet = bool(set(jaccard_join.subset_keys(a, percent, 32).tolist()) & set(jaccard_join.subset_keys(b, percent, 32).tolist()))
                    assert meet or 100 * shared < percent * (s + t - shared)  # what meets is compared afterwards


def test_boundary_is_the_cheapest():
    assert jaccard_join.boundary({}, 90) == 0
    assert 0 < jaccard_join.boundary({5: 1000, 500: 10}, 90) < 32


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 7), (50, 51), (51, 50), (60, 60), (None, 3)]
    out = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in [*range(31), 100]}, 50: 50, 51: 50}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages(spark):
    rng = random.Random(5)
    shared, other = prose(rng, 80, 10**6), prose(rng, 70, 10**6)
    edited = shared.split()
    for k in (9, 25, 44, 61):
        edited[k] = "changed"
    edited = " ".join(edited[:30] + ["put", "in"] + edited[30:])
    texts = ODD + [prose(rng, 200, 10**6) + " " + shared, prose(rng, 20, 10**6) + ". " + shared.upper() + " " + prose(rng, 30, 10**6), edited, other + " " + prose(rng, 20, 10**6), prose(rng, 90, 10**6) + " " + other, prose(rng, 300, 10**6), " ".join(shared.split()[:30])]
    n = len(ODD)
    out = passages.repeated_passages(frame(spark, texts)).collect()
    links = {(n + 1, n), (n + 2, n), (n + 4, n + 3)}  # with the first document, and with the one before as well
    assert links <= {(r.doc_id, r.source_id) for r in out} <= links | {(n + 2, n + 1)}
    exact = next(r for r in out if r.doc_id == n + 1)
    assert (exact.start, exact.end, exact.source_start, exact.similarity) == (20, 100, 200, 1.0)
    fuzzy = next(r for r in out if r.doc_id == n + 2)
    assert fuzzy.end - fuzzy.start >= 78 and 0.8 <= fuzzy.similarity < 1
    docs = frame(spark, texts).withColumnRenamed("n", "n_chars").withColumn("n_chars", passages.F.lit(0).cast("long"))
    left = by_id(passages.remove_passages(docs, passages.repeated_passages(docs)))
    assert n + 2 not in left and set(left) == set(range(len(texts))) - {n + 2}
    assert len(WORD.findall(left[n + 1].text)) == 50 and left[n + 1].n_chars == len(left[n + 1].text)
    assert left[0].text is None and left[n].text == texts[n] and left[n].n_chars == 0
    assert passages.repeated_passages(frame(spark, [])).count() == 0


def test_chains_are_best():
    pos, at = np.array([0, 5, 10, 15, 12, 100]), np.array([50, 55, 60, 65, 3, 150])
    first = passages.chains(pos, at)[0].tolist()
    assert first[:4] == [0, 1, 2, 3] and sorted(sum((c.tolist() for c in passages.chains(pos, at)), [])) == list(range(6))
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 9)
        p, q = rng.integers(0, 30, n), rng.integers(0, 30, n)
        p, q = np.unique(np.column_stack([p, q]), axis=0).T
        best = np.full(len(p), float(passages.K))
        for i in np.lexsort((-q, p)):
            for j in range(len(p)):
                if p[j] < p[i] and q[j] < q[i]:
                    new = min(passages.K, p[i] - p[j], q[i] - q[j])
                    best[i] = max(best[i], best[j] + new - passages.GAP / 2 * (p[i] - p[j] + q[i] - q[j] - 2 * new))
        end = passages.chains(p, q)[0][-1]
        assert best[end] == pytest.approx(best.max())


def test_lowest_of_every_window():
    h = np.random.default_rng(2).integers(0, 50, 300, dtype=np.uint64)
    for n in (1, 2, 12, 47, 300):
        assert passages.lowest(h, n).tolist() == [min(h[i : i + n].tolist()) for i in range(301 - n)]
    assert passages.lowest(h[:5], 12).tolist() == [min(h[:5].tolist())] and not len(passages.lowest(h[:0], 12))


def test_toxicity_learns_gapped_insults(spark):
    rng = random.Random(6)
    insults = ["idiot", "loser", "moron", "scum"]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = prose(rng, 40, 300).replace("x", rng.choice(["a", "en", "or"])).split()
        if toxic:
            w[7], w[20] = rng.choice(insults), rng.choice(insults)
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    docs, known = frame(spark, texts), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    out = by_id(toxicity.score(docs, model))
    held = {r.doc_id for r in docs.where(toxicity.held_out()).select("doc_id").collect()}
    assert held == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(out[i].predicted == y for i, y in labels if i in held)
    odd = ["you i-d-i-o-t", "a l o s e r here", "m.0.r.o.n", "idiiot", "w1a w2a w3a", None, "", "x" * 3000]
    got = by_id(toxicity.score(frame(spark, odd), model))
    assert [got[i].predicted for i in range(8)] == [1, 1, 1, 1, 0, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.keep(frame(spark, odd), model).count() == 4
    assert toxicity.score(frame(spark, []), model).count() == 0
    none = toxicity.train(docs, known.limit(0))
    assert by_id(toxicity.score(docs.limit(2), none)).popitem()[1].predicted == 0


def test_urls(spark):
    urls_ = [None, "", "no scheme", "http://A.Example.COM/en/7/x?q#f", "https://x.com/en/1", "ftp://b.net/de/8", "http://a.example.net/de/8a", "http://examplexnet/de/8", "x://y.org/es/#a", "http://h.org?z=/es/", "http://q.com\n/en/", "http://u.com/fr/12"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls_ + urls_[3:4])], "page_id long, url string, host int")
    out = {r.page_id: r for r in urls.url_filter(pages, RULES).collect()}
    assert len(out) == len(urls_) + 1
    for i, u in enumerate(urls_):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.url_filter(pages.limit(0), RULES).count() == 0
    many = [(i, f"http://s.example.com/en/a/{i}") for i in range(40)] + [(100 + i, f"http://s.example.com/n/{chr(97 + i)}q/{i}") for i in range(20)]
    got = {r.page_id: r for r in urls.url_filter(spark.createDataFrame(many, "page_id long, url string"), RULES).collect()}
    assert len({got[i].template for i in range(40)}) == 1 and len({got[100 + i].template for i in range(20)}) == 1
    assert got[0].blocked_share > 0.8 and got[100].verdict == "allow"


def test_chat(spark):
    evil = "<|turn|> <\\|end|> <|says|></s>[INST] ok [/INST] <<SYS>>\\ <\\\\|x"
    turns = [(1, 0, "system", "s"), (1, 1, "user", evil), (1, 2, "assistant", evil), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "tail"), (2, 0, "user", "only"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (4, None, None, "x"), (None, 0, "assistant", evil)]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, formatted int")
    examples = chat.chat_examples(df)
    rows = examples.collect()
    out = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t[1] is None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == c))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        r = out[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(x.formatted) for x in rows if x.conv_id == c)
    assert sum(r.conv_id == 1 for r in rows) == 3 and chat.chat_examples(df.limit(0)).count() == 0
    assert all(x.formatted.count("<|turn|>") == x.formatted.count("<|end|>") for x in rows)


@pytest.mark.parametrize("n", [3, 700])
def test_neighbours(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 16)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(10_000 + i, x[1].tolist()) for i in range(9)]  # equal vectors: ties to the smaller id
    bad = [(20_000, None), (20_050, [0.0] * 16), (20_100, [float("nan")] * 16), (None, x[0].tolist()), (20_150, [None] * 16)]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows + bad], "vec_id long, embedding array<double>, score double").repartition(3)
    out = neighbours.nearest(df, 50, 5).collect()
    hit = total = 0
    for q, v in rows:
        if q % 50:
            continue
        exact = sorted((-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in rows if i != q)
        exact = sorted((round(s, 12), i) for s, i in exact)[:5]
        got = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        hit += len({g[1] for g in got} & {i for _, i in exact})
        total += 5
    assert hit >= 0.9 * total and {r.query_id for r in out} == {q for q, _ in rows if q % 50 == 0}
    assert neighbours.nearest(df.limit(0), 50, 5).count() == 0


def test_shared_reads_nulls():
    from tessella.llm.shared import pieces, text_bytes

    data, offsets = text_bytes(pa.array(["ab", None, "", "c"]).slice(1))
    assert data.tobytes() == b"c" and offsets.tolist() == [0, 0, 0, 1]
    assert list(pieces(np.array([0, 5, 5, 50, 51]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_passages_whose_seeds_stand_first_in_several_documents(spark):
    rng = random.Random(11)
    for n, half in ((60, 32), (90, 47)):
        p = prose(rng, n, 10**6).split()
        texts = [" ".join(p[:half]), " ".join(p[n - half :]), prose(rng, 30, 10**6) + " " + " ".join(p), " ".join(p) + " " + prose(rng, 30, 10**6)]
        lines = [prose(rng, 10, 10**6) for _ in range(6)]
        texts += [x + " " + prose(rng, 40, 10**6) for x in lines] + [" ".join(lines)] * 2
        out = {(r.doc_id, r.source_id): r for r in passages.repeated_passages(frame(spark, texts)).collect()}
        assert (out[3, 2].start, out[3, 2].end, out[3, 2].similarity) == (0, n, 1.0)
        assert (out[11, 10].start, out[11, 10].end) == (0, 60)


def test_similar_passages_whose_seeds_stand_in_documents_before_and_between(spark):
    """All seeds of two similar passages stand first in shorter pieces before both, and again in pieces between the two."""
    rng = random.Random(21)
    for edit in (lambda x, i: [f"edit{i}"], lambda x, i: [x, f"edit{i}"], lambda x, i: []):
        p = prose(rng, 60, 10**6).split()
        q = [y for i, x in enumerate(p) for y in (edit(x, i) if i in (11, 23, 35, 47) else [x])]
        pieces = [" ".join([*p[i : i + 20], *prose(rng, 30, 10**6).split()]) for i in range(0, 41, 10)]
        again = [" ".join([*prose(rng, 30, 10**6).split(), *p[i : i + 20]]) for i in range(0, 41, 10)]
        texts = [*pieces, prose(rng, 20, 10**6) + " " + " ".join(p), *again, " ".join(q) + " " + prose(rng, 40, 10**6)]
        texts += [prose(rng, 40, 10**6) + " " + " ".join(p[:11]) + " " + prose(rng, 40, 10**6) for _ in range(5)]
        found = {(r.doc_id, r.source_id): r for r in passages.repeated_passages(frame(spark, texts)).collect()}
        assert set(found) == {(11, 5)} and (found[11, 5].start, found[11, 5].end, found[11, 5].source_start) == (0, len(q), 20)


def test_open_seeds_are_looked_up_in_all_earlier_documents(spark):
    """Every stretch of 20 words of which 16 stand at the same places in an earlier document lies in passages, but for ends of three words."""
    rng = random.Random(22)
    parts = [prose(rng, 20, 10**6).split() for _ in range(6)]
    docs = []
    for n in range(60):
        doc = prose(rng, 3, 10**6).split()
        for i in (0, 5, 10, 14) if n % 3 != 1 else ():  # seeds, but no passage
            for x in parts:
                doc += [*x[i : i + 6], *prose(rng, 8, 10**6).split()]
        for _ in range(2) if n % 3 == 1 else ():
            x = list(rng.choice(parts))
            for i in rng.sample(range(20), 4):
                x[i] = f"edit{rng.randrange(10**6)}"
            doc += x + prose(rng, 5, 10**6).split()
        docs.append(doc)
    inside = [set() for _ in docs]
    for r in passages.repeated_passages(frame(spark, [" ".join(x) for x in docs]), min_words=20, similarity=0.8).collect():
        inside[r.doc_id] |= set(range(r.start, r.end))
        assert r.source_id < r.doc_id and r.similarity >= 0.8 and r.end - r.start >= 20
    for d, doc in list(enumerate(docs))[1::3]:
        for source in docs[1:d:3]:
            for p in range(len(doc) - 19):
                for q in range(len(source) - 19):
                    same = [x == y for x, y in zip(doc[p : p + 20], source[q : q + 20], strict=True)]
                    runs = [i for i in range(17) if all(same[i : i + 4])]
                    if sum(same) >= 16 and len(runs) >= passages.LEAST:
                        assert all(any(p + i + k in inside[d] for k in range(4)) for i in runs), (d, p, q)


def test_earlier_sources_against_loops(monkeypatch):
    """In blocks that end inside a seed's places as well, and with counted shingles."""
    rng = np.random.default_rng(23)
    min_words, edits, k = 20, 4, passages.K
    before, after = min_words - k + edits, min_words + edits
    seed, around = [], []
    for s in range(12):
        places = rng.integers(3, 30)
        parts = rng.integers(1, 200, (3, before + after)).astype(np.uint8)
        for _ in range(places):
            row = parts[rng.integers(3)].copy()
            if rng.random() < 0.7:
                some = rng.random(len(row)) < 0.12
                row[some] = rng.integers(1, 200, some.sum())
            if rng.random() < 0.4:
                cut = rng.integers(before + k, len(row) - 1)
                row[cut:] = np.append(row[cut + 1 :], 7) if rng.random() < 0.5 else np.append(7, row[cut:-1])
            if rng.random() < 0.2:
                row[: rng.integers(1, before)] = 0
            if rng.random() < 0.2:
                row[:before] = row[before + k :][:before] = 9  # one word again and again
            row[before : before + k] = (s, 1, 2, 3)
            around.append(row)
            seed.append(s)
    seed, around = np.array(seed), np.array(around)
    doc = np.concatenate([np.sort(rng.integers(0, 40, n)) for n in np.bincount(seed)])
    opened = rng.random(len(doc)) < 0.6

    def shared(a, b, n):
        grams = [tuple(a[i : i + n]) for i in range(edits, len(a) - n + 1 - edits)]
        has = [0 not in x and any(x == tuple(b[j : j + n]) for j in range(i, i + 2 * edits + 1)) for i, x in enumerate(grams)]
        return max(sum(has[i : i + min_words - n + 1]) for i in range(min_words - k + 1)) >= min_words - n + 1 - n * edits

    def seeds(a):
        return {tuple(a[i : i + k]) for i in range(len(a) - k + 1) if 0 not in a[i : i + k]}

    expected = set()
    for i in np.flatnonzero(opened).tolist():
        for j in np.flatnonzero((seed == seed[i]) & (doc < doc[i])).tolist():
            if shared(around[i], around[j], 2) and shared(around[i], around[j], 3) and len(seeds(around[i]) & seeds(around[j])) >= passages.LEAST:
                expected.add((int(doc[i]), int(doc[j])))
    for meeting, few in ((1 << 14, 64), (16, 64), (16, 2), (40, 0)):
        for name, value in (("MEETING", meeting), ("FEW_PLACES", few), ("PAIRS", 50)):
            monkeypatch.setattr(passages, name, value)
        own, source = passages.earlier_sources(seed, doc, opened, around, min_words, edits)
        assert set(zip(own.tolist(), source.tolist(), strict=True)) == expected and len(expected) > 50


def test_documents_of_words_again_and_again_are_no_sources_of_each_other(spark, monkeypatch):
    """One seed in common, but never a chain: next to no pairs (a byte of each word is compared), whose number would grow with the square of theirs."""
    rng = random.Random(24)
    made = {}
    monkeypatch.setattr(passages, "stored", lambda df, name, old=passages.stored: made.setdefault(name, old(df, name)))
    texts = [" ".join(x for i in range(6) for x in [f"w{n}x{i}" if i != 2 else "same"] * rng.randrange(40, 49)) for n in range(30)]
    assert passages.repeated_passages(frame(spark, texts)).count() == 0 and made["pairs"].count() < len(texts) and made["anchors"].count() > 0


def test_of_stretches_within_the_edits_a_piece_that_no_edit_ends_is_looked_up():
    rng = np.random.default_rng(25)
    for min_words, edits, most in ((50, 10, 4), (20, 4, 3), (11, 10, 1)):
        assert passages.words_of_piece(min_words, edits) == most
        for _ in range(150):
            count = min_words + int(rng.integers(0, 40))
            own, size = rng.integers(0, 2**63, count, dtype=np.uint64), rng.integers(1, 14, count)
            h, length = passages.piece_hashes(own, size, most)
            assert all(size[i : i + n].sum() >= passages.PIECE_BYTES or n == most for i, n in enumerate(length.tolist()))
            begin = int(rng.integers(0, count - min_words + 1))
            other, sizes = list(own[begin : begin + min_words]), list(size[begin : begin + min_words])
            for _ in range(edits):
                i, kind = int(rng.integers(len(other))), rng.integers(3)
                other[i : i + (kind != 1)] = [] if kind == 0 else [rng.integers(0, 2**63, dtype=np.uint64)]
                sizes[i : i + (kind != 1)] = [] if kind == 0 else [3]
            kept = np.isin(h, passages.piece_hashes(np.array(other, np.uint64), np.array(sizes), most)[0])
            shared = np.zeros(count, np.int64)
            shared[: len(h)] = np.where(kept | (rng.random(len(h)) < 0.3), rng.integers(2, 1000, len(h)), 0)
            start = passages.tiles(length)
            found = passages.looked_up(start, start + length[start], start, shared, np.ones(count, bool), min_words, edits)
            inside = np.arange(len(h))[found[: len(h)] & kept]
            assert any(begin <= i and i + length[i] <= begin + min_words for i in inside.tolist())


def test_rare_words_between_frequent_ones_need_no_lookup(spark, monkeypatch):
    """Runs of frequent words stand in many documents, but what lies between them in none: nothing is looked up, however many there are."""
    rng = random.Random(26)
    made = {}
    monkeypatch.setattr(passages, "stored", lambda df, name, old=passages.stored: made.setdefault(name, old(df, name)))
    texts = [" ".join(x for _ in range(12) for x in [*rng.choice(["the of and in to a", "of and in to a the"]).split(), *(f"rareword{rng.randrange(10**9)}" for _ in range(4))]) for _ in range(30)]
    assert passages.repeated_passages(frame(spark, texts)).count() == 0 and made["anchors"].count() == 0


def test_few_hashes_get_past_the_bitmap_of_what_is_looked_up(spark):
    held = np.random.default_rng(27).integers(0, 2**40, 3000)
    bits = np.unpackbits(passages.bitmap_of(spark.createDataFrame([(x,) for x in held.tolist()], "h long"), 256), bitorder="little")
    assert bits[held & (len(bits) - 1)].all() and bits.mean() < 1 / 200


def test_passages_with_spread_edits_and_gaps_near_the_ends(spark):
    rng = random.Random(12)
    texts, whole = [], {}
    for n, like in ((50, 0.8), (60, 0.83), (60, 0.85), (80, 0.85), (120, 0.82), (50, 0.86)):
        for even in (True, False):
            base = prose(rng, n, 10**6).split()
            edits = round(n * (1 - like))
            at = [int((i + 0.5) * n / edits) for i in range(edits)] if even else rng.sample(range(3, n - 3), edits)
            whole[len(texts) + 1] = n
            texts += [" ".join(base), " ".join("changed" if i in at else w for i, w in enumerate(base))]
    for k in (9, 46):
        base = prose(rng, 55, 10**6).split()
        whole[len(texts) + 1] = 56
        texts += [" ".join(base), " ".join(base[:k] + ["put"] + base[k:])]
    out = {(r.doc_id, r.source_id): r for r in passages.repeated_passages(frame(spark, texts)).collect()}
    assert set(out) == {(i, i - 1) for i in whole}
    assert all(r.similarity >= 0.8 and r.end - r.start >= 50 for r in out.values())
    assert all(out[i, i - 1].end - out[i, i - 1].start == 56 for i in list(whole)[-2:])


def test_license_gates_drop_nothing(monkeypatch):
    says = ["this work is in the public domain", "this code is gpl", "this work is cc by 4 0", "bsd zero clause", "common development and distribution license", "all rights are reserved", "this file is zlib", "this library is mit", "the page is ms pl"]
    names = [x for *_, name, _ in licenses.NAMES for x in re.sub(r"\(\?:[^()]*\)\??", "", name).split("|") if re.fullmatch(r"[\w ]+", x)]
    texts = [f" {x} ".encode() for x in says + names + [f"{f} {x}" for x in names for f in ("this work is", "released under", "see the")]]
    gated = [licenses.detect(t) for t in texts]
    assert all(gated[: len(says)])
    label = lambda found: [(s, e, r.label, r.priority) for s, e, r in found]
    monkeypatch.setattr(licenses, "RULES", [licenses.Rule(r.label, r.priority, r.confidence, (), r.pattern) for r in licenses.RULES])
    monkeypatch.setattr(licenses, "GATES", (b" ",))
    assert [label(x) for x in gated] == [label(licenses.detect(t)) for t in texts]


def test_unruled_pages_are_blocked_with_their_siblings(spark):
    pages = [(i, f"http://s.example.com/en/a/{i}") for i in range(30)] + [(100 + i, f"http://s.example.com/fr/a/{i}") for i in range(5)]
    pages += [(200 + i, f"http://t.example.com/{x}/a/{i}") for i, x in enumerate(["en", "en/7", "fr"] * 20)]
    got = {r.page_id: r for r in urls.url_filter(spark.createDataFrame(pages, "page_id long, url string"), [*RULES, ("allow", "t.example.com", "/en/")]).collect()}
    assert got[100].rule is None and got[100].verdict == "block" and got[100].template == got[0].template
    assert got[202].verdict == "allow"


def test_equal_stretches_of_a_chain_that_links_too_much(spark):
    rng = random.Random(13)
    same, texts = [prose(rng, 50, 10**6) for _ in range(4)], []
    for _ in range(2):
        texts.append(" ".join(x + " " + prose(rng, 24, 10**6) for x in same))
    out = passages.repeated_passages(frame(spark, texts)).collect()
    covered = {w for r in out for w in range(r.start, r.end)}
    assert {w for i in range(4) for w in range(74 * i, 74 * i + 50)} <= covered


def spoken(rng, parsed):
    """A random text of a rule's language."""
    out = ""
    for kind, x in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(x)
        elif kind == "IN":
            out += chr(rng.choice([c for k, v in x for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1) if str(k) == "RANGE" else [122])]))
        elif kind == "BRANCH":
            out += spoken(rng, rng.choice(x[1]))
        elif kind == "SUBPATTERN":
            out += spoken(rng, x[3])
        elif kind == "MAX_REPEAT":
            out += "".join(spoken(rng, x[2]) for _ in range(rng.randint(x[0], min(int(x[1]), x[0] + 3))))
        else:
            assert kind in ("ASSERT", "CATEGORY"), kind
    return out


def test_every_license_rule_holds_its_keywords_and_a_gate():
    rng = random.Random(41)
    for rule in licenses.RULES:
        parsed = re._parser.parse(rule.pattern.pattern.decode())
        for _ in range(25):
            text = f" {spoken(rng, parsed)} ".encode()
            assert rule.pattern.search(text), text
            assert all(any(k in text for k in own) for own in rule.keywords), (rule, text)
            assert any(g in text for g in licenses.GATES), (rule, text)
            assert any(r.priority >= rule.priority for *_, r in licenses.detect(text)), (rule, text)


def slow_detect(text):
    """All matches of all rules without gates, and suppression by comparing with every kept one: none may contain it."""
    found = [(m.start(), m.end(), r) for r in licenses.RULES for m in r.pattern.finditer(text)]
    kept = []
    for s, e, r in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label)):
        if not any(s2 <= s and e <= e2 for s2, e2, _ in kept):
            kept.append((s, e, r))
    return sorted(kept, key=lambda x: x[:2])


def test_license_rules_against_brute_force(spark):
    rng = random.Random(31)
    words = "the this work software is are licensed released under see gpl gnu general public license licence mit apache 2 0 version v bsd 3 clause cc by nc sa 4 all rights reserved public domain placed in spdx identifier permission and confidential proprietary x".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    out = by_id(licenses.license_scan(frame(spark, texts), PHRASES))
    for i, text in enumerate(texts):
        raw = f" {text} ".encode()
        want = slow_detect(raw)
        assert licenses.detect(raw) == want
        spans = [(raw[:s].count(b" ") - 1, raw[:e].count(b" "), r.label) for s, e, r in want]
        assert [(d.start, d.end, d.label) for d in out[i].detections] == spans
        assert all(text.split()[a:b] == raw[s:e].decode().split() for (a, b, _), (s, e, _) in zip(spans, want, strict=True))


def test_license_scan_of_very_many_notices(spark):
    text = "Licensed under the MIT License. CC BY-NC 4.0. some words\n" * 10_000
    began = time.perf_counter()
    r = licenses.license_scan(frame(spark, [text]), PHRASES).first()
    assert (r.n_base, r.first_word, r.last_word, len(r.detections)) == (20_000, 1, 12 * 9_999 + 5, 20_000)
    assert time.perf_counter() - began < 30


def test_bpe_of_a_very_long_word(library):
    encoder = bpe.PieceEncoder(tokenizer())
    rng = random.Random(32)
    for word in ("".join(rng.choice("abcdefXYZ019+/") for _ in range(1 << 20)), "a" * 100_000):
        tracemalloc.start()
        [(ids, raw)] = encoder.codes([word])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert ids.decode() == "".join(f"{i}," for i in library.encode(word, add_special_tokens=False).ids) and raw.decode() == word
        assert peak < 400 << 20


def kernel(a, b):
    """The string kernel by its definition: all subsequences of both words."""
    def counts(w):
        out = {}
        for n, weight in ((3, 1.0), (4, toxicity.FOUR)):
            for at in itertools.combinations(range(len(w)), n):
                if at[-1] - at[0] < toxicity.SPAN:
                    key = "".join(w[i] for i in at)
                    out[key] = out.get(key, 0.0) + weight * toxicity.DECAY ** (at[-1] - at[0] + 1 - n)
        return out

    x, y = counts(a), counts(b)
    dot = lambda u, v: sum(c * v.get(k, 0.0) for k, c in u.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_toxicity_kernel_and_machine_are_those_of_the_definition():
    rng = random.Random(33)
    letters = "abcde{"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 12))) for _ in range(30)]
    marks = words[:8]
    near = toxicity.Span(marks).near(words)
    assert np.allclose(near, [[kernel(w, m) for m in marks] for w in words], atol=1e-6)
    y = np.array([1.0 if i % 3 == 0 else -1.0 for i in range(30)])
    codes, values, bias = toxicity.Span(marks).solve(words, y, np.ones(30))
    model = toxicity.Model(codes, values, bias, (0.0,) * (toxicity.SIGNS + 1))
    table = toxicity.Scorer(model).values(words)
    # The table's values are those of the machine in the landmarks' space, whose solution has no descent left.
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(gram)
    x = np.column_stack([near @ (vector / np.sqrt(value)), np.ones(30)])
    w = np.linalg.lstsq(x, table, rcond=None)[0]
    assert np.allclose(x @ w, table, atol=1e-4)
    slack = np.maximum(0, 1 - y * table)
    slope = w * np.array([1.0] * 8 + [1e-3]) - 2 * x.T @ (y * slack)
    assert np.abs(slope).max() < 1e-2


def test_toxicity_of_sentences():
    ends = np.array([False, True, False, False, True, False])
    assert toxicity.sentence_starts(ends, np.array([0, 3])).tolist() == [0, 2, 3, 5]
    assert toxicity.sentence_starts(np.zeros(40, bool), np.array([0])).tolist() == [0, 16, 32]
    assert toxicity.folded_sentences("One two. Thr33 é! x") == [["one", "two"], ["three"]]


@pytest.mark.parametrize("n", [2000, 20_000])
def test_neighbours_of_structured_vectors_read_little(n):
    """Recall against brute force and the share of points that a query opens, at two sizes."""
    rng = np.random.default_rng(n)
    centers = rng.normal(size=(n // 50, 16))
    x = neighbours.unit(centers[rng.integers(0, len(centers), n)] + 0.3 * rng.normal(size=(n, 16)))
    forest = neighbours.grow(x)
    points = neighbours.calibrated(forest, x, 5)
    filed = forest.file(x)
    hit = share = 0
    for i in range(100, 200):
        near = x @ x[i]
        near[i] = -2
        opened = forest.open(x[i], points, neighbours.LEAST_LEAVES)
        found = np.isin(filed, opened).any(axis=1)
        hit += found[np.argsort(-near)[:5]].sum()
        share += found.sum() / n / 100
    assert hit >= 0.9 * 500
    assert share < (0.5 if n == 2000 else 0.1)


def test_neighbours_of_very_large_and_very_small_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    scale = [1.0, 1e200, 1e-200, 1e-300]
    df = spark.createDataFrame([(i, (v * scale[i % 4]).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.nearest(df, 50, 5).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(out) == 30
    assert all(abs(r.score - u[r.query_id] @ u[r.vec_id]) < 1e-12 for r in out)


def plain_templates(pages):
    """The tree by loops: pages are (host, shape, n, labelled, blocked)."""
    rows = []
    for host, shape, n, labelled, blocked in pages:
        seg = shape.split("/")
        if len(seg) >= urls.DEPTH:
            seg = seg[: urls.DEPTH - 1] + ["/".join(seg[urls.DEPTH - 1 :])]
        rows.append([host, shape, n, labelled, blocked, seg, ""])
    for depth in range(max((len(r[5]) for r in rows), default=0)):
        nodes = {}
        for r in rows:
            if len(r[5]) > depth:
                nodes.setdefault((r[0], r[6]), []).append(r)
        for members in nodes.values():
            branch = {}
            for r in members:
                own = branch.setdefault(r[5][depth], [0, 0, 0, {}])
                for i in range(3):
                    own[i] += r[2 + i]
                child = r[5][depth + 1] if len(r[5]) > depth + 1 else "/"
                own[3][child] = own[3].get(child, 0) + r[2]
            total = sum(x[0] for x in branch.values())
            wild = {k for k, x in branch.items() if len(branch) > urls.MOST_CHILDREN and x[0] < urls.KEEP_SHARE * total}
            named = [k for k in branch if k not in wild]

            def same(a, b, branch=branch):
                x, y = branch[a], branch[b]
                bound = urls.CONFIDENCE * (x[0] ** -0.5 + y[0] ** -0.5)
                p, q = ({c: m / z[0] for c, m in z[3].items() if m / z[0] >= urls.LEAST_SHARE} for z in (x, y))
                if any(abs(p.get(c, 0) - q.get(c, 0)) > bound for c in p | q):
                    return False
                if x[1] and y[1]:
                    apart = abs(x[2] / x[1] - y[2] / y[1])
                    return apart < urls.MOST_APART and apart <= urls.CONFIDENCE * (x[1] ** -0.5 + y[1] ** -0.5)
                return True

            heavier = {a: [b for b in named if (-branch[b][0], b) < (-branch[a][0], a) and same(a, b)] for a in named}
            leader = {}
            for a in named:
                heads = [b for b in heavier[a] if not heavier[b]]
                if heads:
                    leader[a] = max(heads, key=lambda b: (branch[b][0], b))
            for r in members:
                k = r[5][depth]
                label = "*" if k in wild else "{" + leader[k] + ",..}" if k in leader else "{" + k + ",..}" if k in leader.values() else k
                r[6] = label if depth == 0 else r[6] + "/" + label
    purity = {}
    for r in rows:
        own = purity.setdefault((r[0], r[6]), [0, 0])
        own[0], own[1] = own[0] + r[3], own[1] + r[4]
    return {(r[0], r[1]): (r[6], (purity[r[0], r[6]][1] + urls.WEIGHT * urls.PRIOR) / (purity[r[0], r[6]][0] + urls.WEIGHT)) for r in rows}


def test_url_tree_against_loops(spark):
    rng = random.Random(41)
    pages = []
    for i in range(900):
        host = rng.choice(["a.example.com", "b.example.com", "c.example.net", "d.org"])
        kind = rng.random()
        path = rng.choice(["en", "fr", "de", "es"])
        if kind < 0.3:
            path = f"u/{''.join(rng.choice('abcdefgh') for _ in range(4))}/{rng.choice(['post', 'about', 'en'])}/{rng.randrange(99)}"
        elif kind < 0.6:
            path += f"/{rng.choice('abc')}/{rng.randrange(999)}"
        elif kind < 0.7:
            path += "/" + "/".join(rng.choice("xy") for _ in range(rng.randrange(14)))
        pages.append((i, f"http://{host}/{path}"))
    rules = [*RULES, ("block", "a.example.com", "/u/a"), ("allow", "b.example.com", "/u/b")]
    out = urls.url_filter(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()
    assert len(out) == len(pages)
    counts = {}
    for r in out:
        shape = re.sub("^/", "", re.sub("[0-9]+", "#", r.path))
        own = counts.setdefault((r.host, shape), [0, 0, 0])
        own[0] += 1
        own[1] += r.rule is not None
        own[2] += r.rule is not None and r.verdict == "block"
    want = plain_templates([(*k, *v) for k, v in counts.items()])
    for r in out:
        template, share = want[r.host, re.sub("^/", "", re.sub("[0-9]+", "#", r.path))]
        assert r.template == template and abs(r.blocked_share - share) < 1e-12
        assert r.rule is not None or r.verdict == ("block" if share >= urls.REJECT else "allow")
    users = {r.template for r in out if r.host == "b.example.com" and r.path.startswith("/u/")}
    assert len(users) <= 3  # names are a wildcard, and what stands below them is pooled


def test_large_pools_are_compared_as_far_as_needed(spark, monkeypatch):
    """Many near copies in few comparisons, and links between components that no representative shows."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    shipped = []
    real = jaccard_join.scanned
    monkeypatch.setattr(jaccard_join, "scanned", lambda docs, wanted, *more: (shipped.append(wanted.count()), real(docs, wanted, *more))[1])
    rng = random.Random(51)
    base = prose(rng, 200, 10**6).split()
    copies = [" ".join(w if i != k else "other" for i, w in enumerate(base)) for k in rng.sample(range(200), 150)]
    out = jaccard_join.jaccard_groups(frame(spark, copies), 90, 3, words.VISIBLE, counters=1 << 16).collect()
    assert {r.component_id for r in out} == {0}
    assert sum(shipped) <= 4 * len(copies)  # all pairs of blocks would be 38 copies of each
    chain, texts = list(base), []
    for k in range(40):  # each links with the next ones only
        texts.append(" ".join(chain))
        for _ in range(3):
            chain[rng.randrange(200)] = f"n{rng.random()}"
    texts += copies[:40]
    expected = brute_groups(texts, 90, 3)
    got = by_id(jaccard_join.jaccard_groups(frame(spark, texts), 90, 3, words.VISIBLE, counters=1 << 16))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected


@pytest.mark.parametrize("seed, vocabulary, low, high, tandem", [(0, 10**6, 5, 80, False), (2, 10**6, 1, 60, True), (3, 40, 30, 120, True), (5, 1, 60, 300, False)])
def test_all_windows_of_an_earlier_document_are_found(spark, seed, vocabulary, low, high, tandem):
    """Brute force: every place of 50 words that stand in an earlier document lies in passages; every passage is what it says."""
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(low, high))] for _ in range(30)]
    docs = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 8)):
            chunk, cut = rng.choice(pool), rng.randrange(low)
            chunk = rng.choice([chunk, chunk[cut:], chunk[:cut]])
            words += chunk * (rng.randint(1, 4) if tandem and rng.random() < 0.4 else 1)
            words += [f"u{rng.randrange(10**9)}" for _ in range(rng.randint(1, 30) if rng.random() < 0.3 else 0)]
        docs.append(words)
    covered, seen, places = {}, set(), 0
    for r in passages.repeated_passages(frame(spark, [" ".join(x) for x in docs])).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        a, b = docs[r.doc_id][r.start : r.end], docs[r.source_id][r.source_start : r.source_end]
        assert r.source_id < r.doc_id and len(a) == r.end - r.start >= 50 and r.similarity == r.matched / max(len(a), len(b)) >= 0.8
        assert r.similarity < 1 or a == b
    for i, x in enumerate(docs):
        own = [tuple(x[j : j + 50]) for j in range(len(x) - 49)]
        for j, w in enumerate(own):
            if w in seen:
                places += 1
                assert set(range(j, j + 50)) <= covered.get(i, set())
        seen.update(own)
    assert places
    h, pos = np.array([1, 2, 1, 2, 1, 1, 3, 1], np.uint64), np.array([0, 5, 20, 25, 40, 60, 70, 200])
    assert passages.spaced(h, pos, 50)[1].tolist() == [0, 5, 25, 40, 60, 70, 200]


def test_url_levels_end_in_stored_tables(spark):
    """A level's labels are read back, so the plans of eight levels don't add up on the driver."""
    rows = [("a.com", "", x, "/", 1, 0, 0) for x in "pqr"]
    active = spark.createDataFrame(rows, "host string, prefix string, segment string, next string, n long, labelled long, blocked long")
    labels = urls.labels_of(active)
    plan = labels._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and labels.count() == 3
