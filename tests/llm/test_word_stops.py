"""Where words are cut before the stops at their end, against a walk over each word."""

import random
import re

import pyarrow as pa
import pytest

from buswright.llm.common import utf8, word_bounds
from buswright.llm.token_store import without_stops

_CUT = re.compile(r"(.*[A-Za-z0-9À-ÖØ-öø-ÿ])([.,;:!?]+)", re.S)


@pytest.mark.parametrize("most", [3, 12, 3000])
def test_words_are_cut_before_their_stops(most):
    r = random.Random(most)
    texts = [None, "", ".", "×! é. a÷? 1.. .a. Б."] + [
        " ".join("".join(r.choices("ab1Zé×Б.-", k=r.randrange(4))) + "".join(r.choices(".,;:!?", k=r.randrange(most))) for _ in range(30)) for _ in range(20)
    ]
    data, bounds = utf8(pa.array(texts))
    starts, ends, _ = word_bounds(data, bounds)
    raw = data.tobytes()
    want = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        met = _CUT.fullmatch(raw[s:e].decode())
        want += [met[1].encode(), met[2].encode()] if met else [raw[s:e]]
    starts, ends = without_stops(data, starts, ends)
    assert [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)] == want
