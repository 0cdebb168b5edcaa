"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.common import is_blank, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  #: default of the ``vocabulary`` parameters
#: Fixed value: the pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG_SPACE = re.compile(r"\s{5000}")


def encoder(vocabulary: str):
    """Function from a list of texts to their numbers of tokens. Special tokens' names in a text are ordinary text.

    Files: ``.tiktoken`` (ranks), ``.model`` (sentence pieces), ``.json`` (tokenizers).
    """
    if vocabulary.endswith(".tiktoken"):
        import base64

        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = regex.compile(PATTERN)

        def count(text: str) -> int:
            if LONG_SPACE.search(text):  # the library's own splitter overflows its stack on such runs
                return sum(len(ranked._encode_single_piece(x)) for x in pieces.findall(text))
            return len(ranked.encode_ordinary(text))

        return lambda texts: [count(x) for x in texts]
    if vocabulary.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    return lambda texts: [len(e.ids) for at in range(0, len(texts), 256) for e in t.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]


def _counter(vocabulary: str, prompts: bool):
    def run(batches):
        count = encoder(vocabulary)
        for pdf in batches:
            texts = [x.encode("utf-8", "replace").decode("utf-8") for x in pdf["text"]]  # lone surrogates are no text
            out = pdf.drop(columns=["text"])
            whole = out["tokens"] = count(texts)
            if prompts:
                # The first line is the prompt (title, signature, package name); tokens after it bear loss.
                head = count([x.lstrip().split("\n", 1)[0] for x in texts])
                out["loss_tokens"] = [w - h if w > h else w for w, h in zip(whole, head)]
            yield out

    return run


def token_counts(documents: DataFrame, *keep: str, vocabulary: str = VOCABULARY, prompts: bool = True) -> DataFrame:
    """(doc_id, *keep, tokens, loss_tokens) of every non-blank text, counted over the whole text. A text of one line bears loss as a whole; without ``prompts`` loss_tokens is left out."""
    rows = documents.where(F.col("doc_id").isNotNull() & ~is_blank(F.col("text"))).select("doc_id", *keep, "text")
    types = dict(documents.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ("doc_id", *keep)) + ", tokens int" + (", loss_tokens int" if prompts else "")
    return spread(rows).mapInPandas(_counter(vocabulary, prompts), schema)
