from __future__ import annotations

import random
from collections import Counter

from seekloom.llm.line_frequency import normal_line, quality_rules
from tests.llm.brute import WORD
from tests.llm.conftest import rows_by_id


def name(*numbers):
    return "".join(chr(97 + n // 26) + chr(97 + n % 26) for n in numbers)


def base(text):
    text = text or ""
    found = WORD.findall(text)
    windows = [tuple(found[at : at + 3]) for at in range(len(found) - 2)]
    times = Counter(windows)
    inside = {at + shift for at, w in enumerate(windows) if times[w] > 1 for shift in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(found) < 50 or 100 * len(inside) > 50 * len(found)
    return (
        len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(inside), failed,
    )


def test_base_counts(make_docs):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [
        None, "", "\n \n", "a b c a b c", "x " * 80, f"{long}\n{long}", long, f"{long}\n#1 <b>|\n#1 <b>|\n\t\n",
        "é ü ü\x0b\x0c#&%$*|<> \x85z", "a a a", "line\nline\r\nline\n line", long * 3, "𝔘𝔫𝔦 code 😀",
    ]
    found = rows_by_id(quality_rules(make_docs(list(enumerate(texts)))))
    for at, text in enumerate(texts):
        assert tuple(found[at])[1:7] == base(text), repr(text)


def test_frequent_lines_deplete_documents_of_their_host_only(make_docs):
    own = {i: " ".join("d" + name(i, j) for j in range(60)) for i in range(60)}
    notice = "Subscribe now, call 1-800! " + " ".join("n" + name(j) for j in range(70))
    rows = [(i, f"{own[i]}\n{notice.replace('1', str(i % 7))}", "h") for i in range(20)]
    rows += [(100 + i, f"{own[20 + i]}\n{own[20 + i][:50]}x\n{notice}", None) for i in range(5)]
    rows += [(200 + i, own[40], "h") for i in range(30)]
    found = rows_by_id(quality_rules(make_docs(rows)))
    # On host h 20 contents share the notice; the 30 exact copies are one content.
    assert all(found[i]["depleted"] and not found[i]["kept"] for i in range(20))
    assert all(found[100 + i]["kept"] for i in range(5))
    assert all(found[200 + i]["kept"] and found[200 + i]["removed_words"] == 0 for i in range(30))


def test_limits_and_empty_table(make_docs):
    assert quality_rules(make_docs([])).count() == 0
    rows = [(i, " ".join("r" + name(i, j) for j in range(55)) + "\nshared line", "h") for i in range(12)]
    repeated = rows_by_id(quality_rules(make_docs(rows + rows[:1])))
    assert all(row["removed_words"] == 2 and row["kept"] for row in repeated.values())
    few = rows_by_id(quality_rules(make_docs(rows), max_docs=12))
    assert all(row["removed_words"] == 0 for row in few.values())


def test_the_limit_does_not_grow_with_the_host(make_docs):
    """Fourteen documents of mostly one notice are depleted on a host of 250 and on one of 300."""
    notice = " ".join("n" + name(j) for j in range(70))
    for size in (250, 300):
        rows = [(i, f"{notice}\nown {name(i, 3)}", "h") for i in range(14)]
        rows += [(100 + i, " ".join("d" + name(i % 26, i // 26, j) for j in range(55)), "h") for i in range(size - 14)]
        found = rows_by_id(quality_rules(make_docs(rows)))
        assert [found[i]["depleted"] for i in range(14)] == [True] * 14
        assert all(found[100 + i]["kept"] for i in range(size - 14))
    few = [(i, f"{notice}\nown {name(i, 3)}", "h") for i in range(3)]
    assert all(row["depleted"] for row in quality_rules(make_docs(few), max_share=0.5).collect())
    assert all(row["kept"] for row in quality_rules(make_docs(few)).collect())


def brute_rules(rows, max_docs=10):
    holders = {}
    for _, text, host in rows:
        for line in (text or "").encode().split(b"\n"):
            if line.split():
                holders.setdefault((host, normal_line(line)), set()).add(text)
    result = []
    for doc_id, text, host in rows:
        kept, gone = [], 0
        for line in (text or "").split("\n"):
            data = line.encode()
            if data.split() and len(holders[host, normal_line(data)]) > max_docs:
                gone += len(data.split())
            else:
                kept.append(line)
        counts = base(text)
        verdict = not counts[5] and 100 * gone <= 50 * counts[0]
        result.append((str(doc_id), *counts, gone, verdict, "\n".join(kept)))
    return sorted(result)


def test_whole_verdict_and_texts_against_brute_force(make_docs):
    draw = random.Random(8)
    shared = [" ".join(draw.choice("abcdefgh") + str(n) for _ in range(draw.randint(1, 40))) for n in range(30)]
    shared += ["Call 12 NOW", "call, 34 now!", "***", "  "]
    rows = [(None, None, "h"), (1, "", None), (2, "\n \n", "h"), (2, "\n \n", "h")]
    for at in range(150):
        lines = [draw.choice(shared[: draw.choice([4, 34])]) for _ in range(draw.randint(0, 9))]
        lines.insert(draw.randint(0, len(lines)), " ".join(f"u{at}x{j}" for j in range(draw.choice([3, 60, 90]))))
        rows.append((10 + at, "\n".join(lines), draw.choice(["h", "h", "i", None])))
    rows += rows[20:30]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    names += ["removed_words", "kept", "text"]
    found = [(str(r["doc_id"]), *(r[n] for n in names)) for r in quality_rules(make_docs(rows)).collect()]
    want = brute_rules(rows)
    assert sorted(found) == want
    assert 20 < sum(row[7] > 0 for row in want) and 5 < sum(not row[6] and not row[8] for row in want)


def test_very_long_text(make_docs):
    text = "\n".join(f"line {at} of a very long text" for at in range(100_000))
    row = quality_rules(make_docs([(1, text)])).first()
    assert row["n_words"] == 700_000 and row["removed_words"] == 0 and row["text"] == text


def test_normal_line():
    assert normal_line(b"  Call  12-34, NOW!") == b"call 0000 now"
    assert normal_line(b" *** ") == b"***"
