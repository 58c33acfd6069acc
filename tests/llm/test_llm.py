"""Operators of the llm package against brute force, on odd small tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from retainlab.llm import decontaminate, html_blocks, jaccard, language, lines, packing, personal, phrases, postings, quality, rans
from retainlab.llm.common import apart
from retainlab.llm.groups import components
from retainlab.llm.tokens import Encoder, encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", score double, hash string, removed int, lines int, sequence_id int, label string, block int"


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice("alpha beta gamma delta eta iota kappa lambda omega rho sigma tau phi chi psi zeta".split()) + str(rnd.randint(0, 40)) * rnd.randint(0, 1) for _ in range(n))


def odd_rows() -> list[tuple]:
    rnd = random.Random(7)
    base = prose(rnd, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, ""), (5, None), (6, prose(rnd, 4000)), (7, "one two"), (8, "One  TWO"),
        (9, "line with five words here\nshort\nline with five words here\n" + prose(rnd, 30)), (9, "line with five words here\nshort\nline with five words here\n" + prose(random.Random(9), 30)),
        (10, "Größe  été œuvre   x\n\n 12 a'b don't 'sun <|endoftext|> 中文"), (11, "!!! ###"), (12, base.upper()), (13, prose(rnd, 30)), (13, prose(rnd, 31)), (None, prose(rnd, 25)), (2, base),
    ]
    return [(i, t, ("en", "de", None)[k % 3], None if k % 4 else "s", None) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, "h", 1, 2, 3, "l", 4) for r in odd_rows()], DOCS + EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + EXTRA)


def key(x):
    return (x is not None, x)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_segment_ids_equal_the_library(name):
    rnd, enc = random.Random(3), Encoder(name, limit=50)
    texts = ["".join(rnd.choice("aB é'sßtd.,!09\n\t  ʼ中œ") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    for t in texts + [r[1] or "" for r in odd_rows()]:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == enc.lib.encode(t, add_special_tokens=False).ids, t


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 5, rans.LANES, rans.LANES + 1, rans.BLOCK):
        ids = np.minimum(rng.geometric(0.01, n), 3000)
        coder = rans.Coder(rans.scaled(dict(zip(*map(np.ndarray.tolist, np.unique(ids, return_counts=True)), strict=True))))
        data = coder.encode(ids)
        assert (coder.decode(data) == ids).all()
        assert (coder.decode_part(data, coder.parts(data) - 1) == ids[(coder.parts(data) - 1) * rans.CHECKPOINT * rans.LANES :]).all()
        if n > 5:
            broken = bytearray(data)
            broken[-1] ^= 1
            with pytest.raises(ValueError):
                coder.decode(bytes(broken))
    assert rans.crc_join(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")


def test_rans_corpus(spark, odd, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 2 * rans.LANES)  # documents over several blocks
    monkeypatch.setattr(rans, "CHECKPOINT", 1)
    rans.write_corpus(spark, odd, str(tmp_path / "a"))
    got = sorted(map(tuple, rans.read_digests(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    enc = encoder("byte_bpe_50k.json")
    want = [(r[0], np.frombuffer(enc.encode(r[1] or ""), enc.dtype).tolist() + [0]) for r in odd_rows()]
    assert [r[0] for r in got] == sorted((r[0] for r in want), key=lambda x: (x is not None, x or 0))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    assert sorted((key(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want) == sorted((key(i), n, c) for i, _, n, c in got)
    rans.write_corpus(spark, empty, str(tmp_path / "b"))
    assert rans.read_digests(spark, str(tmp_path / "b")).count() == 0


def test_best_fit_decreasing_by_counts():
    rnd = random.Random(5)
    for _ in range(200):
        window = rnd.choice([7, 16, 50])
        items = [rnd.randint(1, window - 1) for _ in range(rnd.randint(0, 60))]
        counts = {n: items.count(n) for n in set(items)}
        runs, n_windows = packing.best_fit_decreasing(counts, window)
        free: list[int] = []  # one item after the other
        for n in sorted(items, reverse=True):
            fits = [(c, i) for i, c in enumerate(free) if c >= n]
            if fits:
                free[min(fits)[1]] -= n
            else:
                free.append(window - n)
        used: dict[int, list[tuple[int, int]]] = {}
        for n, parts in runs.items():
            for lo, hi, first, each, offset in parts:
                for r in range(lo, hi):
                    used.setdefault(first + (r - lo) // each, []).append((offset + (r - lo) % each * n, n))
        assert sum(len(v) for v in used.values()) == len(items) and len(used) == n_windows == len(free)
        for v in used.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:])) and sorted(v)[0][0] == 0
        assert sorted(window - sum(n for _, n in v) for v in used.values()) == sorted(free)


def test_packing(spark, odd, empty):
    rows = packing.pack(spark, odd, window=64).collect()
    enc = encoder("word_bpe_49k.json")
    want = [(r[0], np.frombuffer(enc.encode(r[1] or ""), enc.dtype).tolist() + [1]) for r in odd_rows()]
    pieces = [(key(i), at, len(x[at : at + 64]), zlib.crc32(np.array(x[at : at + 64], "<u4").tobytes()), len(x)) for i, x in want for at in range(0, len(x), 64)]
    assert sorted(pieces) == sorted((key(r[0]), *r[1:5]) for r in rows)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        ends = np.cumsum([0] + [n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == ends[:-1].tolist() and ends[-1] <= 64
    assert packing.pack(spark, empty).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def groups_of(sets: list[frozenset], linked) -> list[int]:
    label = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and linked(x, y):
                    label[i] = label[j] = min(label[i], label[j])
    return label


def jaccard_linked(x, y):
    return 100 * len(x & y) >= 90 * len(x | y)


def test_jaccard(spark, odd, empty):
    rnd = random.Random(11)
    rows = odd_rows()
    for i in range(20, 80):  # a family of near copies, some further apart than the bound
        w = prose(random.Random(1), 60).split(" ")
        for _ in range(i % 5):
            w[rnd.randrange(60)] = f"new{rnd.randint(0, 9)}"
        rows.append((i, " ".join(w), "en", None, None))
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(r[0], r[1]) for r in rows[len(odd_rows()) :]], "doc_id long, text string"))
    sets = [shingles(r[1]) for r in rows]
    label = groups_of(sets, jaccard_linked)
    least = {g: min((rows[k][0] for k in range(len(rows)) if label[k] == g and rows[k][0] is not None), default=None) for g in set(label)}
    want = sorted((key(r[0]), len(s), key(least[g] if s else r[0])) for r, s, g in zip(rows, sets, label, strict=True))
    got = sorted((key(r["doc_id"]), r["n_shingles"], key(r["component_id"])) for r in jaccard.link_groups(spark, docs).collect())
    assert got == want
    assert jaccard.link_groups(spark, empty).count() == 0


def test_jaccard_without_ids(spark):
    """Near copies all of whose documents have a null id are one component."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words, "more"]), "another text of its own"]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert jaccard.link_groups(spark, docs).select("label").distinct().count() == 2


def test_toggle_bound():
    rnd = random.Random(2)
    for _ in range(200):
        x = jaccard.shingle_set(prose(rnd, rnd.randint(3, 50)))
        y = np.unique(np.concatenate([x[rnd.randint(0, 3) :], jaccard.shingle_set(prose(rnd, rnd.randint(3, 9)))]))
        bits = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(jaccard.toggles(x), jaccard.toggles(y), strict=True))
        assert bits <= len(np.setxor1d(x, y))


def test_components(spark):
    rnd = random.Random(4)
    for n, m in ((1, 0), (30, 20), (60, 55)):
        links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 130)]
        label = {x: x for e in links for x in e}
        for _ in label:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        got = dict(map(tuple, components(spark, spark.createDataFrame(links, "a long, b long")).collect()))
        assert got == {x: g for x, g in label.items() if any(a != b and x in (a, b) for a, b in links)}


def test_decontaminate(spark, odd, empty):
    bench = [(1, "x " + " ".join(odd_rows()[0][1].split(" ")[20:40])), (2, "TWO"), (3, None), (4, ""), (5, "line with five words here"), (6, "TWO"), (7, "never seen in any of these documents at all as such")]
    items = spark.createDataFrame([(i, t, "z") for i, t in bench], "item_id long, text string, hash string")

    def words(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]

    want = []
    for r in odd_rows():
        w, hit, names = words(r[1]), set(), set()
        for i, t in bench:
            x = words(t)
            n = min(10, len(x))
            for s in range(len(x) - n + 1 if x else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit.update(range(p, p + n))
                        names.add(str(i))
        want.append((key(r[0]), len(w), sorted(hit), sorted(names)))
    got = decontaminate.contamination(spark, odd, items).collect()
    assert sorted(want) == sorted((key(r["doc_id"]), r["n_words"], r["hit"] or [], r["items"] or []) for r in got)
    assert decontaminate.contamination(spark, empty, items).count() == 0
    assert decontaminate.contamination(spark, odd, items.limit(0)).filter("hit is not null").count() == 0


def test_edit_distance():
    rnd = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(1500):
        a, b = ([rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        assert lines.edit_distance(a, b) == plain(a, b)


def test_lines(spark, odd, empty):
    rnd = random.Random(8)
    long = prose(rnd, 40).split(" ")
    other = [*long]
    other[3] = "elsewhere"
    more = [(50, " ".join(long) + "\nshort line"), (51, "short line\n" + " ".join(other)), (52, "De.\n" + " ".join(long).upper() + " !!")]
    docs = odd.select(*DOCS.replace(" long", "").replace(" string", "").split(", "), "removed", "lines", "hash")
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, "h") for i, t in more], docs.schema))
    got = lines.without_repeats(spark, docs)
    assert got.columns == [c for c in docs.columns if c not in ("removed", "lines")] + ["lines", "removed"]
    found = [(r["doc_id"], r["text"], r["removed"]) for r in got.collect()]
    by = {i: (t, gone) for i, t, gone in found if i in (50, 51, 52, 4, 5, 1, 2, 12)}
    assert by[50] == (more[0][1], []) and by[51] == ("short line", [1]) and by[52] == ("De.", [1])
    assert by[4] == ("", []) and by[5] == (None, [])
    assert by[1][1] == [] and by[2][1] == [0] and by[12][1] == [0]
    nines = sorted(gone for i, _, gone in found if i == 9)
    assert nines == [[0, 2], [2]]
    assert lines.without_repeats(spark, empty).count() == 0


def test_phrases(spark, odd, empty):
    assert phrases.fingerprints(spark, empty).count() == 0
    rows = sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda r: (key(r[0])[0], r[0] or 0, r[1].encode()))
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        parsed = []
        for x in (t, edited, nxt):
            p = phrases.Parse()
            p.add(x)
            parsed.append(phrases.fingerprint(p.phrases))
        want.append((key(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), parsed[0].tobytes().hex(), phrases.likeness(parsed[0], parsed[1]), phrases.likeness(parsed[0], parsed[2])))
    for parts in (1, 4):
        got = phrases.fingerprints(spark, odd, parts).collect()
        assert sorted(want) == sorted((key(r[0]), r[1], r[2], r[3], r[5], r[6]) for r in got)


def test_personal(spark, odd, empty):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": personal.PATTERNS["card"].pattern, "phone": personal.PATTERNS["phone"].pattern}
    rnd = random.Random(3)
    for _ in range(5000):
        t = "".join(rnd.choice("a@.1-+ 2b@.") for _ in range(rnd.randint(0, 30)))
        want = sorted((m.start(), k, m.end()) for k, kind in enumerate(personal.KINDS) for m in re.finditer(plain[kind], t) if personal._valid(kind, m[0]))
        assert personal.base_spans(t) == want
    texts = [f"call +1 ({a}) 555-{b} now or mail me{a}@site.example.com at 10.0.{a % 250}.7 please" for a, b in zip(range(200, 400), range(2000, 2200), strict=True)]
    texts.append("call +1 (777) 555-1234 and later (777) 555-1234 again, version 2.0 of it")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = personal.fit_personal(docs)
    assert [texts[-1][s:e] for s, k, e in model.added(texts[-1], personal.base_spans(texts[-1]))] == ["(777) 555-1234"]
    assert all(not model.added(t, personal.base_spans(t)) for t in texts[:-1])
    out = personal.find_personal(spark, odd, model).collect()
    assert len(out) == len(odd_rows())
    assert personal.find_personal(spark, empty, personal.fit_personal(empty)).count() == 0
    personal.base_spans("a" * 100_000 + "@ " + "1" * 100_000)  # linear


def test_html(spark):
    tree = html_blocks.train()
    page = "<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One <b>two</b>\n three.<br>four</p><script>var t='</p>'</script><p>" + "word " * 30 + "</p></article><div class='comments'><p>" + "nice " * 20 + "</p></div><footer>&copy; x</footer>"
    assert html_blocks.main_text(page, tree) == "A & B One two three. four " + " ".join(["word"] * 30)
    for odd_page in (None, "", "<", "<p", "<!-- x", "<script>", "a < b", "<div class=", "</p></p>", "<p>" * 5000):
        html_blocks.main_text(odd_page, tree)
    pages = spark.createDataFrame([(1, "u", page, 9), (1, "u", page, 9), (None, None, None, None)], "page_id long, url string, html string, text int")
    assert [len(r["text"]) > 0 for r in html_blocks.extract(spark, pages).orderBy("page_id").collect()] == [False, True, True]
    assert html_blocks.extract(spark, pages.limit(0)).count() == 0


def test_quality(spark, odd, empty):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    model = quality.PairGam()
    model.fit(x[:1000], y[:1000], rounds=60)
    assert ((model.scores(x[1000:]) > 0.5) == y[1000:]).mean() > 0.9
    none = quality.fit_quality(odd, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r["score"] for r in quality.score_quality(spark, odd, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (11, 0), (6, None), (None, 1)], "doc_id long, quality int")
    scored = quality.score_quality(spark, odd, quality.fit_quality(odd, labels, F.lit(True))).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score_quality(spark, empty, none).count() == 0


def test_language(spark, odd, empty):
    rnd = random.Random(6)
    words = {"en": "the of and to in that was for".split(), "de": "der die und nicht ein zu mit auf".split()}
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(40)), x) for i in range(200) for x in (("en", "de")[i % 2],)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.held_out("doc_id", 3, 1)
    model = language.fit_language_model(docs, ~out)
    got = language.predict_language(spark, docs, model).filter(out).collect()
    assert len(got) > 40 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert [r for r in range(50) if zlib.crc32(str(r).encode()) % 3 == 1] == sorted(r["doc_id"] for r in got if r["doc_id"] < 50)
    found = language.predict_language(spark, odd, model)
    assert found.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]
    by = {r["text"]: (r["lang_pred"], r["score"]) for r in found.collect()}
    assert by[None] == by[""] == by["!!! ###"] == ("und", 0.0)
    assert language.fit_language_model(empty, F.lit(True)) is None
    assert language.predict_language(spark, empty, None).count() == 0


def test_simhashes():
    """Part and whole hashes against counting bit by bit; halves and quarters
    at the bounds of line lengths; spans of more than 255 words."""
    rnd = random.Random(3)
    found = [b" ".join(b"w%d" % rnd.randint(0, 400) for _ in range(n)) for n in (5, 9, 15, 16, 18, 19, 40, 3000) for _ in range(4)]
    marks, whole = lines.simhashes(found)

    def bits(words):
        codes = {int(lines.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) >> 24 for w in words}
        mixed = lines.mix64(np.array(sorted(codes), np.uint64)).tolist()
        return [sum(x >> (63 - b) & 1 for x in mixed) for b in range(64)], len(mixed)

    def sign(ones, total):
        value = sum((2 * ones[b] > total) << (63 - b) for b in range(64))
        return value - (1 << 64) if value >> 63 else value

    for line, got, mark in zip(found, marks, whole, strict=True):
        words = line.split()
        cuts = [2] if len(words) < lines.QUARTERED else [4, 2] if len(words) < lines.BOTH else [4]
        parts = [bits([w for j, w in enumerate(words) if k * j // len(words) == i]) for k in cuts for i in range(k)]
        assert got == [sign(*p) for p in parts]
        assert mark == sign([sum(p[0][b] for p in parts) for b in range(64)], sum(p[1] for p in parts))


def spread_lines() -> list[str]:
    """Lines of many lengths and copies of them with edits spread evenly, up to
    a fifth of the words and one more."""
    rnd = random.Random(12)
    out = []
    for n in (5, 6, 9, 10, 12, 15, 15, 20, 25, 33, 40, 40, 61, 80, 80, 120):
        base = [f"{rnd.choice('the of and a in'.split())}" if rnd.random() < 0.3 else f"w{rnd.choice('abcdefgh')}{rnd.choice('klmnop')}{rnd.choice('qrstuv')}" for _ in range(n)]
        out.append(" ".join(base))
        for edits in sorted({1, n // 10, n // 5, n // 5 + 1}):
            for kind in ("replace", "delete", "add"):
                line = [*base]
                for k in reversed(range(edits)):
                    at = (2 * k + 1) * n // (2 * edits)
                    line[at : at + (kind != "add")] = [] if kind == "delete" else [f"new{rnd.choice('abcdefghij')}{rnd.choice('abcdefghij')}"]
                out.append(" ".join(line))
    rnd.shuffle(out)
    return out


def first_of_groups(texts: list[str]) -> set[int]:
    """Numbers of the lines that stay, by all pairs."""
    words = [t.split() for t in texts]

    def linked(x, y):
        most = max(len(x), len(y))
        if min(len(x), len(y)) < 5 or min(len(x), len(y)) * 100 < 80 * most:
            return x == y and bool(x)
        row = list(range(len(y) + 1))
        for i, a in enumerate(x):
            then = [i + 1]
            for j, b in enumerate(y):
                then.append(min(then[-1] + 1, row[j + 1] + 1, row[j] + (a != b)))
            row = then
        return (most - row[-1]) * 100 >= 80 * most

    label = list(range(len(words)))
    for i, x in enumerate(words):
        for j in range(i):
            if label[i] != label[j] and linked(x, words[j]):
                label = [min(label[i], label[j]) if k in (label[i], label[j]) else k for k in label]
    return set(label)


def groups_table(spark, tmp_path, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return docs


def test_lines_all_pairs(spark, tmp_path):
    """op3_lines and the line stage against edit similarity of all pairs."""
    texts = spread_lines()
    stay = first_of_groups(texts)
    assert 16 < len(stay) < len(texts) / 2
    docs = groups_table(spark, tmp_path, texts)
    got = {r["doc_id"] for r in lines.op3_lines(spark, str(tmp_path)).collect() if r["n_removed"] == 0}
    assert got == stay
    kept = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == stay


def test_span_bounds():
    """No alike pair of lines fails the count of shared spans or the bits."""
    found = [t.encode() for t in spread_lines()]
    for size in (1, 2):
        h, of, n, bits = lines.line_spans(found, size)
        sets = [set(h[of == i].tolist()) for i in range(len(found))]
        assert [len(s) for s in sets] == [len(t.split()) - size + 1 for t in found] and n.tolist() == [len(t.split()) for t in found]
        for i, x in enumerate(found):
            for j in range(i):
                if lines.alike(x, found[j], 80):
                    assert len(sets[i] & sets[j]) >= max(lines.least_shared(k, size, 80) for k in (n[i], n[j]))
                    assert sum(int(b & (1 << 64) - 1).bit_count() for b in (bits[i] ^ bits[j]).tolist()) <= 2 * (max(n[i], n[j]) // 5)


def test_short_and_unspaced_lines(spark, tmp_path):
    """Equal short lines go in op3_lines; in scripts without spaces a line is
    as long as its characters."""
    long = "这是一个没有空格的很长的句子用来测试重复的行"
    texts = ["Menu\n" + long, "menu!\n" + long.replace("测", "检"), "...\n\nMenu bar", "...\n\n" + long[:4]]
    groups_table(spark, tmp_path, texts)
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in lines.op3_lines(spark, str(tmp_path)).collect()}
    assert got == {0: (0, texts[0]), 1: (2, ""), 2: (0, texts[2]), 3: (0, texts[3])}


def test_personal_counts_by_kind(spark, tmp_path):
    texts = [
        "a@b.co c@d.org 1.2.3.4 +1 234 567 890 a@b.co", "4111 1111 1111 1111 and 10.0.0.1", "+49 30 1234567 x@y.zz", "", None, "none", "9.9.9.9 8.8.8.8 7.7.7.7",
    ]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in personal.op6_personal(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = personal.base_spans(t or "")
        assert [got[i][f"n_{kind}"] for kind in personal.KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(personal.written(spans).encode()).hexdigest()
    assert [got[0][f"n_{kind}"] for kind in personal.KINDS] == [3, 1, 0, 1]
    assert [got[6][f"n_{kind}"] for kind in personal.KINDS] == [0, 3, 0, 0]


def test_a_written_stage_keeps_no_shuffle_files(spark):
    from retainlab.llm.common import write_stage

    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (blocks.apply(i).getName() for i in range(blocks.size())) if n.startswith("shuffle_")}

    before = files()
    made = write_stage(spark, spark.range(2000).selectExpr("id % 1000 as k").repartition(3, "k").groupBy("k").count(), "kept")
    for _ in range(50):  # files go in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and made.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_pairs_of_a_list_are_those_that_may_share_no_earlier_shingle(spark):
    from retainlab.llm import jaccard

    rows = [(t, s, 100, at, [0] * 4, s) for t, at in ((1, 2), (2, 8)) for s in (10, 20)]
    lists = spark.createDataFrame(rows, "token long, set long, size int, at int, toggles array<long>, label long")
    met = [tuple(r) for r in jaccard.other_pairs(lists, 90).collect()]
    assert met == [(10, 20)]
    # 92 of 100 shingles are left from place 8: too few, if nothing is shared before
    assert jaccard.other_pairs(lists.filter("token = 2"), 90).count() == 0


def test_count_of_ids_takes_a_batch_at_a_time(spark, monkeypatch):
    """One count, as long as the vocabulary, a batch and not a document."""
    made = []
    count = np.bincount
    monkeypatch.setattr(rans.np, "bincount", lambda x, *a, **k: made.append(1) or count(x, *a, **k))
    tokens = spark.createDataFrame([(i, np.array([i % 7, 60_000], "<u2").tobytes()) for i in range(40)], "doc_id long, ids binary")

    class Rows:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return spark.createDataFrame(pa.Table.from_batches(list(run(tokens.toArrow().combine_chunks().to_batches()))))

    assert rans.id_counts(Rows(), "<u2") == {**{i: 40 // 7 + (i < 40 % 7) for i in range(7)}, 60_000: 40}
    assert len(made) == 1


def test_packed_entries(spark):
    """Parts come back as they were sent; only lists of more than one group
    are passed on, all lists of a part that is too long."""
    rng = np.random.default_rng(3)
    token = np.sort(rng.integers(0, 1 << 48, 500).astype(np.uint64))
    columns = token, *(rng.integers(-(1 << 62), 1 << 62, 500) for _ in range(4))
    for sent, got in zip(columns, postings.unpacked(500, postings.packed(*columns), 5), strict=True):
        assert (sent == got).all()

    def lists(*rows):
        token, node, spot, label = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        batches = list(postings.pack(iter([(token.view(np.uint64), node, spot, label)]), 5))
        return sorted(map(tuple, postings.shared_lists(spark.createDataFrame(pa.Table.from_batches(batches))).collect()))

    far = 1 << 47
    rows = [(5, 1, 10, 1), (far, 2, 11, 2), (5, 2, 12, 2), (7, 1, 13, 1), (9, 3, 14, 3), (9, 4, 15, 3), (far, 9, 16, 2)]
    assert lists(*rows) == [(5, 1, 10, False), (5, 2, 12, False)]


def test_too_long_parts_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(lines, "shared_lists", lambda made: postings.shared_lists(made).withColumn("long", F.col("node") >= 0))
    rnd = random.Random(4)
    base = [prose(rnd, 14) for _ in range(30)]
    texts = base + [" ".join(w if i != 5 else "other" for i, w in enumerate(t.split(" "))) for t in base[:12]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {tuple(r) for r in lines.repeated_lines(spark, docs).select("doc_id", "line").collect()}
    monkeypatch.undo()
    assert got == {tuple(r) for r in lines.repeated_lines(spark, docs).select("doc_id", "line").collect()} and len(got) >= 12


@pytest.mark.parametrize("percent", [80, 100])
def test_pairs_of_packed_lists_are_those_of_the_joins(spark, percent):
    rng = np.random.default_rng(5)
    rows = []
    for token in range(60):
        for node in rng.permutation(40)[: rng.integers(1, 12)].tolist():
            rows.append((token * (1 << 41), node, int(rng.integers(0, 4)) << 32 | (20 + node % 5), node % 6, -(1 << 63) + node, (node % 3) << 62 if node % 3 < 2 else -1))
    names = "token long, node long, spot long, label long, x long, y long"
    given = spark.createDataFrame(rows, names)
    nodes = given.select("node", "label", F.array("x", "y").alias("bits")).distinct()
    joined = lines.entry_lists(given.select("token", "node", "spot"), nodes)
    for met, found in ((lines.met_pivots, lines.pivot_pairs), (lines.met_others, lines.other_pairs)):
        got = postings.list_pairs(given, 6, lambda e, met=met: met(e, 2, percent))
        want = {tuple(r) for r in found(joined, 2, percent).collect()}
        assert {tuple(r) for r in got.collect()} == want and (want or percent == 100)
    e = tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True))
    few = {p for a, b in lines.met_others(e, 2, percent, together=1) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert few == want  # of the last of the loop


def test_verified_lines_are_those_of_pairs_only(spark, tmp_path, monkeypatch):
    """Lines of no pair do not meet the pairs."""
    seen = []
    monkeypatch.setattr(lines, "write_stage", lambda spark, df, name: seen.append(df) or df)
    many = spark.range(50).select(F.col("id").alias("node"), F.lit(b"a b c d e f").alias("words"))
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [tuple(r) for r in lines.verified(spark, many, pairs, 80).collect()] == [(1, 2)]
    assert "LeftSemi" in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def changed(rnd, words, share):
    return [f"new{rnd.randrange(10**6)}" if rnd.random() < share else w for w in words]


def test_wide_bits_of_long_lines(spark):
    """Alike lines of any length pass, most unlike ones that 128 bits let pass do not."""
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, pairs, linked = [], [], set()
    for i, n in enumerate([5, 40, 64, 65, 120, 300, 900, 2500] * 4):
        words = [rnd.choice(vocabulary) for _ in range(n)]
        other = changed(rnd, words, 0.15) if i % 2 else [rnd.choice(vocabulary) for _ in range(n)]
        rows += [(2 * i, " ".join(words).encode()), (2 * i + 1, " ".join(other[: max(5, n - n // 50)]).encode())]
        pairs.append((2 * i, 2 * i + 1))
        if lines.alike(rows[-2][1], rows[-1][1], 80):
            linked.add(pairs[-1])
    found = [r[1] for r in rows]
    _, _, n, bits = lines.line_spans(found, 2)
    wide = lines.wide_bits(found)
    assert [w is None for w in wide] == [k <= 64 for k in n.tolist()]
    assert all(len(w) * 8 >= 2 * k for w, k in zip(wide, n.tolist(), strict=True) if w)
    table = [(i, k, b, bytearray(w) if w else None) for (i, _), k, b, w in zip(rows, n.tolist(), bits.tolist(), wide, strict=True)]
    table = spark.createDataFrame(table, "node long, n int, bits array<long>, wide binary")
    got = {tuple(r) for r in lines.possible(table, spark.createDataFrame(pairs, "a long, b long"), 80).collect()}
    assert linked <= got and len(linked) > 10
    unlike = [p for p in pairs if n[p[0]] >= 120 and p[0] % 4 == 0]
    assert unlike and not got & set(unlike)


def test_wide_toggles_of_large_sets():
    """Sets that link differ in no more bits than the limit, folded or not."""
    rnd = np.random.default_rng(3)
    for n in (200, 256, 257, 500, 512, 513, 1020, 5000):
        x = np.unique(rnd.integers(0, 1 << 64, n, np.uint64))
        cut = n // 25
        y = np.unique(np.concatenate([x[cut:], rnd.integers(0, 1 << 64, cut // 2, np.uint64)]))
        unlike = np.unique(rnd.integers(0, 1 << 64, n, np.uint64))
        both = len(np.intersect1d(x, y))
        assert both * 100 >= 90 * (len(x) + len(y) - both)
        a, b, c = map(jaccard.wide_toggles, (x, y, unlike))
        assert (a is None) == (len(x) <= 256)
        if a and b:
            assert apart(a, b) <= len(x) + len(y) - 2 * both and apart(a, b) <= (len(x) + len(y)) * 10 // 190
        if a and c:
            assert apart(a, c) > (len(x) + len(unlike)) * 10 // 190


def test_only_near_sets_are_read(spark, tmp_path, monkeypatch):
    """Pairs of large sets are sifted by their wide bits before texts are joined."""
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(changed(rnd, words, 0.01)), " ".join(changed(rnd, words, 0.2))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written = {}
    write = jaccard.write_stage
    monkeypatch.setattr(jaccard, "write_stage", lambda spark, df, name: written.setdefault(name, []).append(write(spark, df, name).cache()) or written[name][-1])
    monkeypatch.setattr(jaccard, "remove_stage", lambda spark, df: None)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_groups(spark, docs, percent=90).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    assert sum(t.count() for t in written["near"]) == 1
