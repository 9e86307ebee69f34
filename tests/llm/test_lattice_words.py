"""Words through the relational lattice against the library's encoding."""

import random

from gleanery.llm import sentencepiece as S


def test_every_word_of_the_lattice_is_encoded_as_by_the_library(spark):
    import sentencepiece as library

    model, pieces, rnd = library.SentencePieceProcessor(model_file=S.MODEL), S.Pieces(), random.Random(4)
    assert pieces.late == {S.BLANK * 16}
    names = [p for p in pieces.table if S.BLANK not in p]
    words = {S.BLANK + "".join(rnd.choice(names) for _ in range(rnd.randrange(1, 9))) for _ in range(1500)} | {S.BLANK * 20 + "x", S.BLANK * 40, S.BLANK + "ab" * 60, S.BLANK + "日本é😀", S.BLANK + "a" * 61, S.BLANK + "a" * 62}
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    for r in S.encode_words(rows, pieces).collect():
        assert list(r.ids) == model.encode(r.word.replace(S.BLANK, " ")[1:]), r.word
