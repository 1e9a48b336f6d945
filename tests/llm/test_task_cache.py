"""The token writer leaves nothing behind in the worker if it is told so, and writes the same."""

import gc

from spiketide.llm import binary


def test_encoder_of_a_task_is_small_and_equal():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "\n".join(f"word{k} and w{k}, (x{k}) again" for k in range(300))
    small = binary._load(path, 50)
    assert small(text).tolist() == binary._encoder(path)(text).tolist()
    del small
    gc.collect()
    left = [x for x in gc.get_objects() if isinstance(x, binary._Pieces)]
    assert len(left) == 2 and all(x.most == binary.CACHE for x in left)
