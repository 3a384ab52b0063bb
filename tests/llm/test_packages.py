"""Packages that other writers make, and licence texts with words put in."""

import gzip
import io
import json
import zipfile

import pytest

from dossierlake.llm import licenses, warc


def package(archives, index, indexed="indexes/index.cdxj"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in archives.items():
            z.writestr(name, data)
        z.writestr(indexed, index)
        z.writestr("indexes/readme.txt", "not an index")
    data = out.getvalue()
    return lambda at, n: data[at : at + n], len(data)


def plain_record(i, payload, http=True):
    block = (b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" if http else b"") + payload
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [True, False])
def test_several_archives_and_a_compressed_index(zipped):
    shut = gzip.compress if zipped else bytes
    first = [shut(plain_record(i, b"one %d" % i)) for i in range(3)]
    second = [shut(plain_record(9, b"two", False))]
    lines = ["!meta 0 {}"]
    at = 0
    for raw in first:
        lines.append("com,x)/ 2000 " + json.dumps({"offset": str(at), "length": str(len(raw)), "filename": "a.warc.gz"}))
        at += len(raw)
    lines.insert(2, "com,y)/ 2000 " + json.dumps({"offset": 0, "length": len(second[0]), "filename": "archive/b.warc.gz"}))
    index = gzip.compress("\n".join(lines).encode())
    read, size = package({"archive/a.warc.gz": b"".join(first), "archive/b.warc.gz": second[0]}, index, "indexes/index.cdxj.gz")
    assert [p for _, p in warc.read_package(read, size)] == [b"one 0", b"two", b"one 1", b"one 2"]
    bad = json.dumps({"offset": 0, "length": 5, "filename": "c.warc.gz"})
    read, size = package({"archive/a.warc.gz": first[0]}, f"x 1 {bad}".encode())
    with pytest.raises(ValueError):
        list(warc.read_package(read, size))


def test_records_have_ids_of_their_own_and_http_heads():
    w = warc.PackageWriter()
    for _ in range(2):
        w.add(7, "http://x/", b"HTTP/ is no head here", None)
    w.add(None, "http://y/", b"", None)
    data = w.finish()
    z = warc.ZipRanges(lambda at, n: data[at : at + n], len(data))
    raw = [z.member(warc.ARCHIVE)[x["offset"] : x["offset"] + x["length"]] for x in warc.index_lines(z)]
    heads = [warc.parse_record(x) for x in raw]
    assert len({h["warc-record-id"] for h, _ in heads}) == 3 and all(b.startswith(b"HTTP/1.1 200 OK\r\n") for _, b in heads)
    found = list(warc.read_package(lambda at, n: data[at : at + n], len(data)))
    assert [(h.get("x-page-id"), p) for h, p in found] == [("7", b"HTTP/ is no head here")] * 2 + [(None, b"")]


@pytest.mark.parametrize(("text", "label"), [
    ("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: Apache-2.0", "apache-2"), ("SPDX-License-Identifier: BSD-2-Clause", "bsd-2"),
    ("Redistribution and use of any kind in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    ("Permission is hereby granted, free of charge, to any person (or firm) obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "mit"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "gpl-3"),
    ("All rights reserved; the license of this software is not free of charge", ""), ("", ""),
])
def test_licence_texts_with_words_put_in_or_left_out(text, label):
    n, _, labels, placings = licenses.RareTokenIndex().scan("some words first " + text + " and some more words after")
    assert set(labels) == ({label} if label else set()), labels
    assert all(0 <= a < b and 0 < s <= 1 for a, b, _, s in placings) and n >= 8
