import math
import random
import re

import numpy as np
import pyarrow as pa
from conftest_llm import WORDS, prose, rows, table

from quillon.llm import common, secrets
from quillon.llm.queries import QUERIES

ALPHABETS = dict(zip(secrets.NAMES, secrets._ALPHABETS, strict=True))


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def naive(token):
    """(encoding, three p-values) by the definitions."""
    t = token.encode()
    has = lambda s: any(c in s for c in t)
    up, low, digit = has(ALPHABETS["upper"]), has(ALPHABETS["lower"]), has(ALPHABETS["digits"])
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token) and digit and (up or low):
        kind = "hex"
    elif re.fullmatch("[A-Z2-7]+", token) and up and digit:
        kind = "base32"
    elif re.fullmatch("[A-Z0-9]+", token) and up and digit:
        kind = "upper36"
    elif re.fullmatch("[a-z0-9]+", token) and low and digit:
        kind = "lower36"
    elif token.isalpha():
        kind = "upper" if token.isupper() else "lower" if token.islower() else "letters"
    elif token.isdigit():
        kind = "digits"
    elif token.isalnum():
        kind = "base62"
    else:
        kind = "base64url" if re.search("[-_]", token) and not re.search("[+/]", token) else "base64"
    v = [ALPHABETS[kind].find(c) if kind != "hex" else int(chr(c), 16) for c in t]
    v = [max(0, x) for x in v]
    n, a = len(v), len(ALPHABETS[kind])
    chi = sum(v.count(x) ** 2 for x in set(v)) * a / n - n
    shape = (a - 1) / (2 * (n - 1) / n)
    p1 = tail((((chi / (a - 1)) ** (1 / 3)) - (1 - 1 / (9 * shape))) * 3 * math.sqrt(shape))
    high = [x * 2 >= a for x in v]
    runs, above = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False)), sum(high)
    m = 2 * above * (n - above) / n
    sd = math.sqrt(max(0, m * (m - 1) / (n - 1)))
    p2 = min(1, 2 * tail(abs(runs - 1 - m) / sd)) if sd > 0 else 0
    mean = sum(v) / n
    sq = sum((x - mean) ** 2 for x in v)
    p3 = min(1, 2 * tail(abs(sum((x - mean) * (y - mean) for x, y in zip(v, v[1:], strict=False)) / sq + 1 / n) * math.sqrt(n))) if sq > 0 else 0
    return kind, (p1, p2, p3)


def test_battery_by_definition():
    r = random.Random(3)
    tokens = ["".join(chr(c) for c in r.choices(a, k=r.choice([16, 20, 33, 64, 200]))) for a in ALPHABETS.values() for _ in range(15)]
    tokens += ["a" * 20, "deadbeef" * 4, "ABCDEF0123456789", "the-quick-brown-fox", "camelCaseWordsAreLongToo", "a/b-c_d+e/f-g_h+i"]
    data = np.frombuffer("".join(tokens).encode(), np.uint8)
    kind, p = secrets.battery(data, np.r_[0, np.cumsum([len(t) for t in tokens])[:-1]])
    for t, k, got in zip(tokens, kind, p, strict=True):
        want = naive(t)
        assert secrets.NAMES[k] == want[0], t
        assert np.allclose(got, want[1], atol=2e-6), t


def test_uniform_strings_pass_and_words_do_not():
    rng = np.random.default_rng(5)
    for name in ("hex", "base32", "lower36", "base62"):
        a = np.frombuffer(ALPHABETS[name], np.uint8)
        data = rng.choice(a, 40 * 2000).astype(np.uint8)
        _, p = secrets.battery(data, np.arange(0, len(data), 40))
        assert (np.minimum(1, 3 * p.min(1)) >= secrets.ALPHA).mean() > 0.995
        assert 0.3 < np.median(p[:, 0]) < 0.7


def test_step_up_by_sorting():
    rng = np.random.default_rng(6)
    shape = len(secrets.EDGES), len(secrets.NAMES), secrets.BINS
    null, seen = rng.poisson(0.3, shape), rng.poisson(0.05, shape)
    null[:, 0], seen[:, 0] = 0, rng.poisson(2, shape[2])
    got, p = secrets.accepted_cells(null.ravel(), seen.ravel(), q=0.2)
    p = p.reshape(shape)
    for k in range(shape[0]):
        values = np.sort(np.repeat(p[k].ravel(), seen[k].ravel()))
        good = [v for i, v in enumerate(values, 1) if v <= 0.2 * i / len(values)]
        limit = max(good, default=-1)
        random_enough = np.arange(secrets.BINS) < 32
        want = {(k * shape[1] + e) * shape[2] + b for e in range(shape[1]) for b in range(shape[2]) if p[k, e, b] <= limit and random_enough[b]}
        mine = {c for c in got if c // (shape[1] * shape[2]) == k}
        assert mine == want


def planted(seed, n=60):
    r = random.Random(seed)
    made, documents = {}, []
    for i in range(n):
        key = {0: "".join(r.choices("0123456789abcdef", k=40)), 1: "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), 2: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=48))}.get(i % 6)
        if key and (i % 6 or re.search("[a-f]", key)):
            made[i] = key
        documents.append((i, f"é {prose(i, 80)} {'token = ' + chr(34) + key + chr(34) if key else ''} {' '.join(r.choices(WORDS, k=50))} supercalifragilisticexpialidocious internationalization-of-applications 4555595528066772 {prose(-i, 20)}"))
    return made, documents


def test_planted_secrets(spark):
    made, documents = planted(1)
    texts = dict(documents)
    got = secrets.secrets(table(spark, [(i, t, "en") for i, t in documents])).collect()
    assert {(r.doc_id, texts[r.doc_id][r.start : r.end]) for r in got} == set(made.items())
    assert all(r.p_value <= secrets.Q for r in got)
    clean = secrets.redact(table(spark, [(i, t, "en") for i, t in documents]))
    assert {r.doc_id: r.text for r in clean.collect()} == {i: t.replace(made.get(i, "\0"), "[SECRET]") for i, t in documents}


def test_edges(spark, edge, empty, edge_rows):
    made, documents = planted(2, 12)
    more = table(spark, [*edge_rows, *[(i, t, "en") for i, t in documents], (None, documents[0][1], "en"), documents[0] + ("en",), documents[0] + ("en",)])
    got = secrets.secrets(more).collect()
    assert {r.doc_id for r in got} == {*made, None} and len([r for r in got if r.doc_id == 0]) == 3
    out = secrets.redact(more)
    assert out.columns == more.columns and out.count() == more.count()
    assert out.where("text is null").count() == 2 and out.where("text = ''").count() == 1
    assert rows(secrets.secrets(empty)) == [] and rows(secrets.redact(empty)) == []
    assert rows(secrets.secrets(edge)) == [] and rows(secrets.redact(edge)) == rows(edge)


def test_padding_and_places():
    from quillon.llm.common import blob
    import pyarrow as pa

    r = random.Random(9)
    body = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=42))
    data, offsets = blob(pa.array(["", body + "==", body + "==="]))
    row, start, end, *_ = secrets.candidates(data, offsets)
    assert row.tolist() == [1, 2] and (end - start).tolist() == [44, 44]


def test_query(spark, sf):
    got = QUERIES["op9_secrets"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(i, m.group()) for i, t in texts.items() for m in re.finditer(r"(?<![\w+/-])(?:[0-9a-f]{40}|AKIA[A-Z0-9]{16})(?![\w+/-])", t)}
    assert {(r.doc_id, texts[r.doc_id][r.start : r.end]) for r in got} == want


def test_joined_secrets(spark):
    """A secret is found and masked whatever a separator joins it to, and so are hyphenated UUIDs."""
    r = random.Random(12)
    draw = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    hexa, base62 = "0123456789abcdef", ALPHABETS["base62"].decode()
    made, documents = {}, []
    for i in range(120):
        key, around = [
            (draw(hexa, 40), "deploy/token/{}"), (draw(hexa, 64), "key-{}"), (draw(hexa, 32), "secret_key_{}"), (draw(base62, 48), "users/keys/{}/view"),
            ("-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), "{}"), ("-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), "items/{}/view"),
        ][i % 6]
        made[i] = key
        documents.append((i, f"{prose(i, 60)} https://example.org/{around.format(key)} {prose(-i - 1, 60)} internationalization-of-applications and/or-the_other/way-around", "en"))
    texts = {i: t for i, t, _ in documents}
    docs = table(spark, documents)
    got = [(x.doc_id, texts[x.doc_id][x.start : x.end]) for x in secrets.secrets(docs).collect()]
    assert len(set(got)) == len(got)
    hit = {i for i, s in got if made[i] in s}
    assert len(hit) >= 0.98 * len(made)
    assert [(s, made[i]) for i, s in got if made[i] not in s or len(s) > len(made[i]) + 24] == []
    clean = {x.doc_id: x.text for x in secrets.redact(docs).collect()}
    assert {i for i in made if made[i] not in clean[i]} == hit
    assert all("internationalization-of-applications and/or-the_other/way-around" in t for t in clean.values())


def test_long_texts_come_in_pieces(monkeypatch):
    """The same candidates whether a text is taken whole or in pieces; a long token's tests are the same block by block."""
    r = random.Random(2)
    code = lambda n, a: "".join(chr(c) for c in r.choices(ALPHABETS[a], k=n))
    words = lambda n: " ".join(r.choices(WORDS, k=n))
    texts = ["".join(f"{words(r.randint(1, 40))} é {r.choice(['key-', 'a/b/', ''])}{code(r.choice([20, 40, 64]), r.choice(['hex', 'base62', 'base64']))}= " for _ in range(12)) for _ in range(5)] + ["", words(30)]
    data, offsets = common.blob(pa.array(texts))
    whole = secrets.tested(data, offsets)
    for size in (64, 200, 900):
        got = []
        for a, b, low, high in common.stretches(offsets, data, secrets.BREAK, size):
            row, start, end, kind, p, cell, _ = secrets.tested(data[low:high], np.clip(offsets[a : b + 1], low, high) - low)
            got += list(zip((a + row).tolist(), (low + start).tolist(), (low + end).tolist(), kind.tolist(), p.round(6).tolist(), cell.tolist(), strict=True))
        assert sorted(got) == sorted(zip(*(whole[0].tolist(), whole[1].tolist(), whole[2].tolist(), whole[3].tolist(), whole[4].round(6).tolist(), whole[5].tolist()), strict=True))
    tokens = [code(5000, a) for a in ("hex", "base62", "base64", "upper36")] + ["z" * 3000, "ab" * 2000, code(50, "hex")]
    flat = np.frombuffer("".join(tokens).encode(), np.uint8)
    first = np.r_[0, np.cumsum([len(t) for t in tokens])[:-1]]
    kind, p = secrets.battery(flat, first)
    monkeypatch.setattr(secrets, "LONG", 700)
    kind2, p2 = secrets.battery(flat, first)
    assert (kind == kind2).all() and np.allclose(p, p2, atol=1e-6)


def test_a_very_long_run(spark, monkeypatch):
    """A run far longer than a piece: found whole, masked whole, and a key joined to it is found as a part."""
    monkeypatch.setattr(secrets, "LONG", 500)
    r = random.Random(3)
    run = "".join(chr(c) for c in r.choices(ALPHABETS["base64"], k=4000))
    data, offsets = common.blob(pa.array([f"x {run} y"]))
    row, start, end, *_, cell, number = secrets.tested(data, offsets)
    assert (start[0], end[0]) == (2, 4002) and (cell[1:] >= secrets.CELLS).all() and set(number.tolist()) == {0}
    assert all(0 <= s < e <= 4004 for s, e in zip(start, end, strict=True))
