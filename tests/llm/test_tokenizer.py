import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.llm.tokenizer import Encoder, decode_documents, encode_documents, read_vocabulary

PATH = os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return Encoder(*read_vocabulary(PATH)), lambda x: t.encode(x, add_special_tokens=False).ids


def ids(encoder, text):
    import numpy as np

    return np.frombuffer(encoder.encode(text), np.int32).tolist()


CASES = ["", " ", "\n\n  x", "a  b\t\tc \r\n d", "<|endoftext|> 'll 've's", "ééé 日本語のテキスト 😀👍🏽", "x" * 5000, "ab" * 3000 + "　", "1234567890" * 50, "\x1c\x1d a \x85b\xa0c​", "foo(bar, baz=[1,2,3])  # done", "   ", "\n", "a\n", "Áé"]


@pytest.mark.parametrize("text", CASES)
def test_same_ids(both, text):
    assert ids(both[0], text) == both[1](text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=["Cs", "Cn"]), st.sampled_from("aabbett hing's \n\t.,()_01")), max_size=60))
def test_same_ids_and_round_trip(both, text):
    got = ids(both[0], text)
    assert got == both[1](text)
    assert both[0].decode(got) == text.encode()


def test_frames(spark):
    rows = [(1, "def f(x): return x"), (2, ""), (3, None), (4, "  \n"), (4, "again"), (None, "z")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, ids string")
    out = encode_documents(df, PATH)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = out.collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert got[1]["ids"] == [] and got[2]["ids"] == []
    assert [r["text"] for r in decode_documents(out, PATH).collect()] == ["def f(x): return x", "", "", "  \n", "again", "z"]
    assert encode_documents(df.limit(0), PATH).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    import json

    good = json.load(open(PATH))
    small = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4}, "merges": ["a b", "b c"]}, "pre_tokenizer": good["pre_tokenizer"]}
    (tmp_path / "v.json").write_text(json.dumps(small))
    assert read_vocabulary(str(tmp_path / "v.json"))[1] == [(0, 1, 3), (1, 2, 4)]
    for wrong in (small | {"pre_tokenizer": {"type": "Whitespace"}}, small | {"normalizer": {"type": "NFC"}}, small | {"model": small["model"] | {"merges": ["b c", "a b"]}}):
        (tmp_path / "v.json").write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            read_vocabulary(str(tmp_path / "v.json"))
