import random
import re
import textwrap

import pyarrow as pa
from conftest_llm import WORDS, prose, rows, table
from oracle import compare

from quillon.llm import common, licenses
from quillon.llm.queries import ORACLE_SQL, QUERIES


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return set(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", low))


def brute(documents, templates, threshold):
    out = []
    for i, text in documents:
        lines = (text or "").split("\n")
        starts = [sum(len(x) + 1 for x in lines[:b]) for b in range(len(lines))]
        for name, t in templates.items():
            want = tokens(t)
            found = []
            for n in range(1, licenses.LINES + 1):
                for b in range(len(lines) - n + 1):
                    block = " ".join(lines[b : b + n])
                    both = len(want & tokens(block))
                    few = n == 1 or len(re.findall(r"[0-9a-zA-Z\u0080-\U0010ffff]+", block)) <= licenses.MOST_WORDS * len(want)
                    if want and few and both >= threshold * len(want) - 1e-9 and both and not any(b <= x and x + m <= b + n for x, m in found):
                        found.append((b, n))
                        end = starts[b + n - 1] + len(lines[b + n - 1]) + (b + n < len(lines))
                        out.append((i, b, n, starts[b], end, name, both, both / len(want)))
    return sorted(out, key=repr)


def test_random_blocks_equal_brute_force(spark):
    r = random.Random(4)
    templates = {f"t{k}": " ".join(r.sample(WORDS, r.randint(1, 9))) for k in range(25)} | {"empty": "...", "same": "fox fox FOX"}
    documents = [(i, "\n".join(" ".join(r.choices(WORDS, k=r.choice([0, 1, 3, 5, 20]))).title() for _ in range(r.randint(1, 6)))) for i in range(150)]
    for threshold in (0.5, 0.8, 1.0):
        got = licenses.scan(table(spark, [(i, t, "en") for i, t in documents]), templates, threshold=threshold)
        want = brute(documents, templates, threshold)
        assert rows(got) == want and {x[2] for x in want} >= {1, 2, 3}


def test_global_order(spark):
    docs = table(spark, [(1, "a b\na", "en"), (2, "a c", "en")])
    n = licenses.counts(docs, {"t": "a b c d"})
    assert n == {b"a": 3, b"b": 1, b"c": 1, b"d": 0}
    assert licenses.Vocabulary({"t": "a b c d"}, n).words == [b"d", b"b", b"c", b"a"]


def test_edges(spark, edge, empty, edge_rows):
    notice = licenses.TEMPLATES["mit-notice"]
    more = [*edge_rows, (20, f"é {notice}\n\n{notice.upper()}", "en"), (21, f"{prose(3, 30_000)}\n{notice}", "en"), (None, notice, "en"), (20, f"é {notice}\n\n{notice.upper()}", "en")]
    got = rows(licenses.scan(table(spark, more)))
    assert got == brute([(i, t) for i, t, _ in more], licenses.TEMPLATES, licenses.THRESHOLD) and len(got) >= 6
    assert rows(licenses.scan(empty)) == [] and rows(licenses.scan(edge, {})) == []


def test_wrapped_notices(spark):
    """Long notices wrapped at 72 columns, with comment signs, are found where they stand."""
    for name in ("mit-grant", "apache-2.0-limits", "gpl-grant", "bsd-grant", "isc-grant", "bsd-endorsement"):
        wrapped = "\n".join("# " + x for x in textwrap.wrap(licenses.TEMPLATES[name], 72))
        assert wrapped.count("\n")
        text = f"{prose(name, 60)}\n\n{wrapped}\n\n{prose(name + 'b', 60)}\n"
        got = [r for r in licenses.scan(table(spark, [(1, text, "en")])).collect() if r.template == name]
        assert len(got) == 1 and got[0].lines <= wrapped.count("\n") + 1 and text.index(wrapped) <= got[0].start < got[0].end <= text.index(wrapped) + len(wrapped) + 1


def test_long_texts_come_in_pieces(monkeypatch):
    """The same blocks whether a text is taken whole or in pieces of a few bytes."""
    r = random.Random(6)
    vocabulary = licenses.Vocabulary({f"t{k}": " ".join(r.sample(WORDS, r.randint(2, 9))) for k in range(10)}, threshold=0.6)
    texts = ["\n".join(" ".join(r.choices(WORDS, k=r.choice([0, 1, 3, 5, 20]))) for _ in range(r.randint(0, 40))) for _ in range(9)] + ["\n\n", "é" * 60, ""]
    data, offsets = common.blob(pa.array(texts))

    def every():
        out = []
        for a, own, bounds, count, line, rank in licenses.lines_of(data, offsets, vocabulary):
            for found in licenses.join(own, bounds, count, line, rank, vocabulary):
                out += [(int(a + i), int(bounds[f] - own[i]), int(bounds[f + n] - own[i]), int(t), int(o)) for i, f, t, n, o in zip(*found, strict=True)]
        return sorted(out)

    whole = every()
    assert whole
    for size in (16, 60, 300):
        monkeypatch.setattr(licenses, "stretches", lambda o, d, stop, n=size: common.stretches(o, d, stop, n))
        assert every() == whole


def test_query(spark, sf):
    compare(QUERIES["op5_licenses"](spark, sf), ORACLE_SQL["op5_licenses"], sf)
