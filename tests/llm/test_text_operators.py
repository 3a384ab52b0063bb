"""Operators whose result a document's text alone decides, against plain re-statements of their rules."""

import collections
import hashlib
import re
import zlib

import pytest

from dossierlake.llm import licenses, packing, pii, quality, warc
from dossierlake.llm.common import Words

ODD = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, spans string, _own string"
CARD = "4111 1111 1111 1111"
IBAN = "DE89 3704 0044 0532 0130 00"
TEXTS = [
    None, "", " \n\t ", "word", f"pay {CARD} now", f"iban {IBAN} please", "mail a@b@c.com or x..y@d-e.f.g, ip 1.2.3.4.5 and 300.1.1.1 256.0.0.1",
    "call +1 (743) 555-3824, or +123 (", "ssn 123-45-6789 social", "phone (212) 555-0100", "@a.b@c.d +1.2.3.4", "1.2..3.4.5.6 00000001.2.3.004",
    "Ünïcödé 🎉 a@b.cd 🎉 10.0.0.1", "x " * 60 + "Under the MIT License. CC BY-NC 4.0", "apache license, VERSION 2! apache license version 2", "a b c a b c a b c",
    "line one\nline one\n\n line one\nother", "same words here " * 40, "#hash & <b>|%$* " * 30, "9" * 5000, "a." * 4000 + "@x.y", "long " * 30000,
    "This work is licensed under the GNU General Public License, version 3.", "permission is hereby granted free of charge to any person",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", None, 7, None, "x", "y") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "no id " * 20, None, None, 1, None, None, None, None)]
    return spark.createDataFrame(rows, ODD)


def given(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def check(docs, got, rule, names):
    want = collections.Counter((i, *rule(t)) for i, t in given(docs))
    assert collections.Counter(tuple(r[n] for n in ("doc_id", *names)) for r in got) == want


def base_spans(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)]
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii_base_spans(docs):
    def rule(text):
        base = base_spans(text)
        n = collections.Counter(k for k, *_ in base)
        return (*[n[k] for k in pii.BASE_KINDS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())

    check(docs, pii.span_digest(docs).collect(), rule, ("n_email", "n_ip", "n_card", "n_phone", "base_sha256"))


def test_pii_adds_confirmed_kinds_and_redacts(docs):
    text = f"iban {IBAN} please; iban DE88 3704 0044 0532 0130 00; ssn 123-45-6789 social; id 123-45-6789 x"
    assert [k for k, *_ in pii.find(text)] == ["iban", "ssn"] or [k for k, *_ in pii.find(text)] == ["iban", "ssn", "ssn"]
    assert pii.redact("a@b.cd x", pii.find("a@b.cd x")) == "[EMAIL] x"
    rows = {r.doc_id: r for r in pii.redact_pii(docs).collect()}
    assert rows[0].text is None and rows[4].text == "pay [CARD] now" and rows[4].n_chars is not None and rows[4].spans == "x"
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")


@pytest.mark.parametrize("iban", ["NO9386011117947", "BE68539007547034", "CH9300762011623852957", "HR1210010051863000160", "GB82WEST12345698765432", "FR1420041010050500013M02606", "MT84MALT011000012345MTLCAST001S"])
def test_ibans_of_every_length_modulo_four(iban):
    spaced = " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))
    for t in (iban, spaced, iban[:4] + " " + " ".join(iban[i : i + 3] for i in range(4, len(iban), 3)) if len(iban) == 22 else spaced):
        for after in ("", ".", " CHF 5", " A", f" {spaced}"):
            found = [t_[2] - t_[1] for t_ in pii.propose(f"iban {t}{after}") if t_[0] == "iban"]
            assert found == [len(t)] + [len(spaced)] * (after == f" {spaced}"), (t, after)
    assert pii.redact(f"iban {spaced}!", pii.find(f"iban {spaced}!")) == "iban [IBAN]!"


def test_licenses(docs):
    def rule(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
        hits = [(i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))

    got = licenses.scan_licenses(docs).collect()
    check(docs, got, rule, ("n_words", "n_base", "first_word", "last_word", "base_labels"))
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[22] == ("gpl-3", 1.0) and labels[0] == ("", 0.0) and labels[23][0] == ""
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def quality_rule(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), len(words) < 50 or 100 * len(repeat) > 50 * len(words)


def test_quality_measures_and_verdict(docs, spark):
    got = quality.quality_rules(docs).collect()
    check(docs, got, quality_rule, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert not any(r.kept and r.base_failed for r in got)
    prose = [(i, " ".join(f"w{i}x{k} plain{k} text" for k in range(60)), "en", "a") for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{i}x{k}### t{k}%%%" for k in range(60)), "en", "a") for i in range(10)]
    rows = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(rows[i] for i, *_ in prose) and not any(rows[i] for i, *_ in junk)


@pytest.mark.parametrize("good_sources", ["bbcc", "bcdx", "aaaa"])
def test_hot_junk_does_not_widen_the_fences(spark, good_sources):
    """A third of the rows is junk: a source of its own beside one to three good ones ('x': small ones), or mixed into the only one."""
    source = lambda i: f"x{i}" if good_sources[i % 4] == "x" else good_sources[i % 4]
    prose = [(i, " ".join(f"w{i}x{k} plain{k} text" for k in range(60)), "en", source(i)) for i in range(800)]
    junk = [(1000 + i, " ".join(f"w{i}x{k}### t{k}%%%" for k in range(60)), "en", "a") for i in range(400)]
    rows = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(rows[i] for i, *_ in prose) and not any(rows[i] for i, *_ in junk)


def test_filter_quality_keeps_columns(docs):
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality_rules(docs).collect() if r.kept}


def test_packing(docs):
    from tokenizers import Tokenizer
    import numpy as np

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(docs).collect()
    want = collections.Counter()
    for i, t in given(docs):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for k, (start, n) in enumerate(packing.cut(len(ids))):
            want[i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= packing.SEQUENCE
    assert len(held) <= -(-sum(r.length for r in got) // packing.SEQUENCE) + 1


@pytest.mark.parametrize("n", [1, 2, 2047, 2048, 2049, 4096, 5000])
def test_cut(n):
    parts = packing.cut(n)
    assert sum(x for _, x in parts) == n and all(x == 2048 for _, x in parts[1:]) and [s for s, _ in parts] == [sum(x for _, x in parts[:i]) for i in range(len(parts))]


def test_word_cache_equals_tokenizer():
    from tokenizers import Tokenizer

    tok, cache = Tokenizer.from_file(packing.default_tokenizer()), packing.WordCache(packing.default_tokenizer())
    for t in ["a  b", " a", "a ", "a \n b", "\n\n  x  y  z", "it's  we'll 'tis", "x\x1c y", "", "  ", "é́ ñ 日本 語"]:
        assert [int.from_bytes(x, "little") for x in (cache.ids(t)[i : i + 4] for i in range(0, len(cache.ids(t)), 4))] == tok.encode(t, add_special_tokens=False).ids, t


def test_added_tokens_keep_their_ids(spark):
    from tokenizers import Tokenizer
    import numpy as np

    tok, cache, mark = Tokenizer.from_file(packing.default_tokenizer()), packing.WordCache(packing.default_tokenizer()), "<|endoftext|>"
    texts = [f"abc {mark} def", mark, mark * 3, f"a  {mark}  b", f"\n{mark}\n\n x", f"<|{mark}|>", mark[:-1], mark.upper(), f"it{mark}'s", f"<|endoftext{mark}"]
    for t in texts:
        assert np.frombuffer(cache.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t
    assert np.frombuffer(cache.ids(texts[0]), "<u4").tolist() == [39305, 220, 50256, 825]
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == {i: zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in enumerate(texts)}


def test_archives(spark):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, "u2", None), (5, "u5", ""), (4, "u 4\n", "é" * 100), (3, "u3", "same"), (None, "n", "same"), (None, None, "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    digest = lambda t: warc.digest32((t or "").encode())
    want = collections.Counter()
    for i, _, t in rows:
        same = [x for x, _, y in rows if (y or "") == (t or "") and x is not None]
        first = min(same, default=None)
        want[i, len((t or "").encode()), digest(t), "response" if i == first else "revisit", None if i == first else first] += 1
    got = warc.archive_round_trip(pages.withColumnRenamed("url", "url")).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_zip64_and_broken_packages():
    w = warc.PackageWriter()
    for i in range(20):
        w.add(i, f"http://x/{i}", f"payload {i}".encode() * i, None if i % 3 else 7)
    data = w.finish()
    reads = []

    def read(at, n):
        reads.append(n)
        return data[at : at + n]

    found = list(warc.read_package(read, len(data)))
    assert [h["warc-record-id"] for h, _ in found] == [f"<urn:page:{i}>" for i in range(20)]
    assert all(b == (f"payload {i}".encode() * i if i % 3 else b"") for i, (_, b) in enumerate(found))
    # the same archive behind a ZIP64 end record
    end = data.rfind(b"PK\x05\x06")
    count, size, start = int.from_bytes(data[end + 10 : end + 12], "little"), int.from_bytes(data[end + 12 : end + 16], "little"), int.from_bytes(data[end + 16 : end + 20], "little")
    import struct

    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    tail = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = data[:end] + end64 + locator + tail
    assert len(list(warc.read_package(read, len(data)))) == 20
    with pytest.raises(ValueError):
        warc.ZipRanges(lambda at, n: data[: end - 10][at : at + n], end - 10)


def test_words_split_bytes_like_the_pattern():
    texts = ["a  b\n", "", "\x1c x y", " z"]
    w = Words(texts)
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.bounds, w.bounds[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


def test_empty_tables(docs):
    none = docs.limit(0)
    assert [f(none).count() for f in (pii.span_digest, licenses.scan_licenses, quality.quality_rules, packing.pack_documents)] == [0, 0, 0, 0]
