"""No gate hides a match of its rule."""

import itertools
import re
from re import _parser

import pyarrow as pa
import pytest

from specsift.llm.license_rules import gates, rules
from specsift.llm.licenses import _gated, _scan, detect
from specsift.llm.words import ALNUM, split_words


def samples(items):
    """A match of every alternative; repeats at their least and one more."""
    parts = []
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "SUBPATTERN":
            parts.append(samples(list(value[3])))
        elif name == "BRANCH":
            parts.append([x for b in value[1] for x in samples(list(b))])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            parts.append([x * n for n in {low, min(low + 1, high)} for x in samples(list(inner))])
        elif name == "IN":
            parts.append([chr(v) if str(o) == "LITERAL" else {"CATEGORY_WORD": "w", "CATEGORY_DIGIT": "3"}[str(v)] for o, v in value])
        else:
            raise ValueError(name)
    return ["".join(x) for x in itertools.product(*parts)]


def test_every_alternative_passes_its_gates():
    for label, kind, _, pattern in rules():
        some = samples(list(_parser.parse(pattern)))
        known = gates(pattern)
        assert all(known), pattern
        for text in some:
            assert re.fullmatch(pattern, text)
            assert any(g in text for g in known), (pattern, text)
        texts = ["no match here", *[" \n".join(x.upper().split(" ")) for x in some], "nor here"]
        (words,) = split_words(pa.array(texts), ALNUM)
        assert set(range(1, len(some) + 1)) <= _gated(words), pattern
        assert all(detect(f" {x} ") for x in some), pattern


@pytest.mark.parametrize(
    "text, label",
    [
        ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa-4.0"),
        ("under CC\nBY SA 4.0 only", "cc-by-sa-4.0"),
        ("Commons Clause", "commons-clause"),
        ("BSD 3-Clause", "bsd-3-clause"),
        ("MIT No Attribution", "mit-0"),
        ("Historical Permission Notice and Disclaimer", "hpnd"),
        ("Bitstream Vera Fonts Copyright", "bitstream-vera"),
        ("the PSF license", "python"),
        ("IJG license", "ijg"),
    ],
)
def test_texts_that_were_skipped(text, label):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["commons", text, "clause"])], names=["doc_id", "text"])
    (out,) = _scan(iter([batch]))
    assert out.column("labels").to_pylist() == ["", label, ""]
