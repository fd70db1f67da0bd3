import zlib

import numpy as np
from tokenizers import Tokenizer

from tests.llm import brute
from tidegrid.llm import packing

TEXTS = ["<|endoftext|> x", "a <|endoftext|> x", "a\n<|endoftext|><|endoftext|>  b", "<|endoftext|", "plain", "", "x" + " " * 1_100_000 + "y", "<|endoftext|>" + "\n" * 1_100_000]


def test_op10_has_the_ids_of_the_default_tokenizer(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer, want = Tokenizer.from_file(packing.vocabulary()), []
    for k, text in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(k, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert brute.ordered([tuple(r)[:5] for r in packing.op10(spark, str(tmp_path)).collect()]) == brute.ordered(want)
