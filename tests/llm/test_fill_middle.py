import hashlib
import random
import re

import pytest

from pyrogrid.llm import fill_middle as fm

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def cases():
    draw = random.Random(5)
    letters = "aZ bä\n<>PSM€𝄞1é|" + "xyz" * 4
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(300)]
    texts += [None, "", "a", "<", "word " * 3, "has <S> mark", "<P>", "a<" * 50, "S>M>" * 20, "<P" * 30,
              # Runs and single code points over several blocks, and block edges inside a run.
              "q" * 20000, "ab1" * 30000, "é" * 9001, "q" * 4096 + " " + "r" * 4095 + "é", "a" * 8192]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, "no id here"), (3, rows[3][1]), (3, "another text with the same id")]


def test_equals_a_list_of_units(spark):
    rows = cases()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    found = fm.transform(docs)
    found = found.withColumn("again", fm.restored(found["output"], found["form"])).collect()
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found), key=repr)
    assert got == sorted(((i, *brute(i, t)) for i, t in rows), key=repr)
    assert sorted((r["doc_id"], r["again"]) for r in found if r["doc_id"] is not None) == sorted(
        (i, t or "") for i, t in rows if i is not None)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fm.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_places_for_small_blocks(size):
    for _, text in cases()[:80]:
        text = text or ""
        units = fm.Units(text, size)
        found = [m.start() for m in UNIT.finditer(text)] + [len(text)]
        assert units.count == len(found) - 1
        assert [units.place(k) for k in range(len(found))] == found
