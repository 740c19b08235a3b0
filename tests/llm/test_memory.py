"""Memory that the operators take beside one very long text: measured in a process of its own for each."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
SIZE = 24 << 20
#: What each operator does to a column of one long text.
WORK = {
    "simhash": "simhash.fingerprint(data, offsets)",
    "langid": "langid.Model({'a': [b'some words of it'], 'b': [b'other ones']}).bits(data, offsets)",
    "licenses": "v = licenses.Vocabulary(licenses.TEMPLATES)\nfor x in licenses.lines_of(data, offsets, v):\n    list(licenses.join(*x[1:], v))",
    "quality": "quality.Network(np.zeros((quality.WIDTH, 256, quality.FILTERS)), np.random.default_rng(0)).freeze().score(data, offsets)",
    "decontaminate": "list(decontaminate.search(data, offsets, decontaminate.Items([1], ['one two three four five six seven eight nine ten eleven twelve thirteen']), 13))",
    "substrings": "for x in substrings.digests(data, offsets, 'sentence'):\n    pass",
    "secrets": "for a, b, x, y in common.stretches(offsets, data, secrets.BREAK, secrets.LONG):\n    secrets.tested(data[x:y], np.array([0, y - x]))\n    for c, d, e, f in common.stretches(np.array([0, y - x]), data[x:y], ~secrets.ALNUM, secrets.LONG):\n        secrets.ordinary(data[x:y][e:f], np.array([0, f - e]))",
    "audio": "head = b'RIFF....WAVEfmt ' + struct.pack('<IHHIIHH', 16, 1, 1, 8000, 8000, 1, 8) + b'data\\xff\\xff\\xff\\xff'\nfor x in audio.clips(pa.array([head + text])):\n    pass",
    "bpe": "bpe.codec(open(bpe.VOCABULARY, 'rb').read()).encode([text])",
}
CODE = """
import resource, struct, sys
import numpy as np
import pyarrow as pa
from quillon.llm import audio, bpe, common, decontaminate, langid, licenses, quality, secrets, simhash, substrings
if sys.argv[1] == "prose":
    text = b"".join(b"Line %d holds a few words, 3a%08x7f%dz of them odd.\\n" % (i, i * 2654435761 % 2**32, i) for i in range({size} // 52))
else:
    text = b"ab7cd" * ({size} // 5)
data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{work}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


@pytest.mark.parametrize("name", WORK)
def test_beside_a_long_text(name):
    got = subprocess.run([sys.executable, "-c", CODE.format(size=SIZE, work=WORK[name]), "prose"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]
    # results that grow with the text are a few times its size; the rest is what a piece takes
    assert float(got.stdout) < 360, f"{name} took {got.stdout.strip()} MB beside a text of {SIZE >> 20} MB"


@pytest.mark.parametrize("name", ["simhash", "substrings", "secrets", "licenses", "quality", "langid"])
def test_a_text_of_one_word(name):
    got = subprocess.run([sys.executable, "-c", CODE.format(size=SIZE, work=WORK[name]), "word"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]
    assert float(got.stdout) < 400, f"{name} took {got.stdout.strip()} MB beside a word of {SIZE >> 20} MB"
