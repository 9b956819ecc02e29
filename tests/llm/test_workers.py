"""What operators keep in a worker doesn't stay through the stages of others."""

from haplospark.llm import common, minhash, packing


def test_a_stage_drops_what_other_operators_keep():
    import public_tokenizers

    packing.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    minhash._worker_hasher()
    sizes = []

    def rows(batches):
        sizes.append((packing.word_bpe.cache_info().currsize, minhash._worker_hasher.cache_info().currsize))
        yield from batches

    assert list(common.released(rows, "minhash")([1, 2])) == [1, 2]
    assert sizes == [(0, 1)]
    common.release()
    assert minhash._worker_hasher.cache_info().currsize == 0
