"""Markdown out of blocks, against a plain walk over the lines that keeps track of what has been taken."""

import random
import re

import pytest

from dossierlake.operators import reconstruct as R

SCHEMA = "document string, page long, block_id long, kind string, order double, x0 double, y0 double, x1 double, y1 double, text string, lines array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>, anchored boolean, decorative boolean, reason string, path string, caption string"
POOL = ["0101.21.00", "0101.29.00 0102.10.00", "0103.10.00 LIVE SWINE", "0104.10.00 of sheep and goats", "LIVE HORSES", "ASSES AND MULES", "Mixed Line Of WORDS", "plain words that say more.", "a line of small words", "CHAPTER 3", "(Source: desk)", "Figure 2: a horse", "12", "IV. list", "Half OF the LETTERS UP"]


def made(seed):
    rng = random.Random(seed)
    rows = []
    for page in (1, 2):
        y = 10.0
        for k in range(rng.randint(4, 9)):
            lines = [rng.choice(POOL) for _ in range(rng.randint(1, 4))]
            kind = rng.choice(["text"] * 5 + ["image", "table"])
            height = rng.choice([12.0, 30.0]) * len(lines)
            rows.append((f"d{seed}", page, page * 100 + k, kind, float(k), 20.0, y, 300.0, y + height, "\n".join(lines) if kind != "image" else None, None, rng.random() < 0.15, rng.random() < 0.3, None, rng.choice([None, "a.png"]), rng.choice([None, "A horse"])))
            y += height + rng.choice([6, 20, 60, 150])
    return rows


CODE = re.compile(r"^((?:\d{4}\.\d{2}\.\d{2}\b\s*)+)(.*)$")


def is_title(text, line, tables):
    letters = [c for c in text if c.isalpha()]
    inside = any(t[1] == line["page"] and t[5] <= (line["x0"] + line["x1"]) / 2 <= t[7] and t[6] + 2 <= (line["y0"] + line["y1"]) / 2 <= t[8] for t in tables)
    odd = CODE.match(text) or re.match(r"CHAPTER \d|\(Source:|Figure", text) or re.match(r"\d+\.?$|[ivxlcdm]+\. ", text, re.I)
    return bool(text) and not odd and len(text.split()) <= 14 and not inside and bool(letters) and sum(c.isupper() for c in letters) >= 0.6 * len(letters)


def ends(text):
    letters = [c for c in text if c.isalpha()]
    share = sum(c.isupper() for c in letters) / len(letters) if letters else 0
    return bool(re.match(r"CHAPTER \d|\(Source:|Figure", text) or re.match(r"\d+\.?$|[ivxlcdm]+\. ", text, re.I) or re.search(r"[.!?]\s*$", text)) or share < 0.45


def walked(blocks):
    """The parts of one document's Markdown, block by block and line by line."""
    number = lambda b: b[3] == "text" and re.fullmatch(r"\d{1,3}", b[9].strip()) and b[6] >= 650
    blocks = sorted((b for b in blocks if not number(b)), key=lambda b: (b[1], b[6], b[5]))
    tables = [b for b in blocks if b[3] == "table"]

    def lines_of(b):
        texts = b[9].split("\n")
        h = max(1, (b[8] - b[6]) / len(texts))
        return [{"block": b[2], "page": b[1], "i": i, "text": t, "x0": b[5], "x1": b[7], "y0": b[6] + h * i, "y1": b[6] + h * (i + 1)} for i, t in enumerate(texts)]

    def body(lines):
        out, run = [], []
        for t in lines:
            if t.startswith("(Source:"):
                out += [" ".join(run)] * bool(run) + [t]
                run = []
            else:
                run.append(t)
        return out + [" ".join(run)] * bool(run)

    parts, used = [], {}
    for k, b in enumerate(blocks):
        if b[3] == "image":
            if not b[12]:
                parts += ([f"![{b[15] or b[2]}]({b[14]})", f"<!-- image-id: {b[2]} -->"] if b[14] else [f"<!-- image: {b[2]} -->"]) + ([f"*Caption: {b[15]}*"] if b[15] else [])
            continue
        if b[3] == "table":
            parts.append(b[9])
            continue
        lines = lines_of(b)[used.get(b[2], 0) :]
        if b[11] and not any(CODE.match(x["text"]) or x["text"].startswith("CHAPTER") for x in lines_of(b)):
            parts += body([x["text"] for x in lines if x["text"].startswith("(Source:")])
            continue
        rest, skipped = [], set()
        for at in lines:
            if at["i"] in skipped:
                continue
            if at["text"].startswith("CHAPTER"):
                parts += body(rest) + ["# " + at["text"]]
                rest = []
                continue
            m = CODE.match(at["text"])
            if not m:
                rest.append(at["text"])
                continue
            parts += body(rest)
            rest = []
            after = [x for x in lines_of(b) if x["i"] > at["i"]] + [x for n in blocks[k + 1 :] if n[3] == "text" for x in lines_of(n)]
            codes, taken, inline = m[1].split(), [at], m[2]
            while not inline and after and (n := CODE.match(after[0]["text"])) and after[0]["page"] == taken[-1]["page"] and after[0]["y0"] - taken[-1]["y1"] <= 45:
                codes += n[1].split()
                taken.append(after.pop(0))
                inline = n[2]
            last, title, chosen = taken[-1], [], []
            if inline and is_title(inline, last, tables):
                title.append((inline, last))
            for x in after:
                if CODE.match(x["text"]):
                    break
                if not title:
                    if x["page"] != last["page"] or x["y0"] - last["y1"] > 140:
                        break
                    if is_title(x["text"], x, tables):
                        title.append((x["text"], x))
                        chosen.append(x)
                    elif ends(x["text"]):
                        break
                elif is_title(x["text"], x, tables) and x["y0"] - title[-1][1]["y1"] <= 30:
                    title.append((x["text"], x))
                    chosen.append(x)
                else:
                    break
            shared = []
            if len(codes) > 1:
                for x in after[after.index(chosen[-1]) + 1 if chosen else 0 :]:
                    if CODE.match(x["text"]) or x["text"].startswith("CHAPTER"):
                        break
                    if not (re.fullmatch(r"\d{1,3}", x["text"]) and x["y0"] >= 650):
                        shared.append(x)
            for x in [*taken, *chosen, *shared]:
                if x["block"] == b[2]:
                    skipped.add(x["i"])
                else:
                    used[x["block"]] = max(used.get(x["block"], 0), x["i"] + 1)
            name = " ".join(t for t, _ in title)
            for c in codes:
                parts.append(f"## {c}" + (f" — {name}" if name else ""))
                parts += [f"Grouped HS code set: {', '.join(codes)}."] * (len(codes) > 1) + (["Shared description:", *body([x["text"] for x in shared])] if shared else [])
        parts += body(rest)
    return "\n\n".join(parts)


@pytest.fixture(scope="module")
def rows():
    return [r for seed in range(60) for r in made(seed)]


def test_markdown_equals_a_walk(spark, rows):
    got = {r.document: r.markdown for r in R.markdown(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = {d: walked([r for r in rows if r[0] == d]) for d in {r[0] for r in rows}}
    wrong = [d for d in want if got.get(d, "") != want[d]]
    assert not wrong, f"{len(wrong)}\n{got.get(wrong[0])}\n=====\n{want[wrong[0]]}"
    assert sum("Shared description" in x for x in want.values()) > 5 and sum(" — " in x for x in want.values()) > 20


def test_lines_in_tables_are_no_titles(spark):
    block = lambda i, kind, y, text, **k: ("d", 1, i, kind, float(i), 0.0, y, 100.0, y + 10, text, None, False, False, k.get("reason"), None, None)
    rows = [block(1, "text", 0.0, "0101.21.00"), block(2, "text", 20.0, "ROWS"), block(3, "table", 18.0, "|a|"), block(4, "text", 40.0, "LIVE HORSES")]
    title = lambda rows: next(r.text for r in R.markdown_parts(spark.createDataFrame(rows, SCHEMA)).collect() if r.text.startswith("##"))
    assert title(rows) == "## 0101.21.00 — LIVE HORSES"
    rows[2] = block(3, "table", 18.0, "|a|", reason="aligned")
    assert title(rows) == "## 0101.21.00 — ROWS LIVE HORSES"
    assert R.markdown_parts(spark.createDataFrame([], SCHEMA)).count() == 0
