import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing, token_counts, tokens

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y \n<|endoftext|>\n\n z", "<|endoftext", "<|ENDOFTEXT|> it's", "é <|endoftext|>é", ""]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_added_tokens_are_those_of_the_tokenizers_library(whole):
    assert whole[0] == [64, 220, 50256, 275]
    assert [tokens.token_ids(t, tokens.default_ranks()) for t in TEXTS] == whole
    version = next(v for v in token_counts.VERSIONS if v != "words_v1")
    assert [token_counts.count_tokens(t, version) for t in TEXTS] == [len(ids) for ids in whole]


def test_packed_lengths_count_added_tokens(spark, whole):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert {r.doc_id: r.length for r in packing.pack_documents(docs).collect()} == {d: len(ids) + 1 for d, ids in enumerate(whole)}
