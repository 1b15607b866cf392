import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def ranks_path():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="session")
def tokenizer_path():
    return public_tokenizers.path("byte_bpe_50k.json")
