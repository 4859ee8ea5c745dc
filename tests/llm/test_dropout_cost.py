"""Agendas of many units do not set off the garbage collector, which looked through all their lists again and again."""

import gc

import public_tokenizers

from factloom.llm import merge_dropout


def test_no_collections_among_agendas():
    e = merge_dropout.DropoutEncoder(public_tokenizers.path("piece_bpe_32k.model"), 0.1, 17)
    found = []
    note = lambda phase, info: found.append(phase)
    gc.callbacks.append(note)
    try:
        ids, sizes = e.units([b" word%d" % k for k in range(20_000)], [k % 7 for k in range(20_000)])
    finally:
        gc.callbacks.remove(note)
    assert len(sizes) == 20_000 and sizes.sum() == len(ids)
    assert len(found) <= 2 and gc.isenabled()
