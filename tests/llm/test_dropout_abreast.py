"""Agendas worked out many at a time give what one at a time gives, and one at a time is left for very long units only."""

import random

import numpy as np
import public_tokenizers

from factloom.llm import merge_dropout as m


def test_agendas_abreast():
    e = m.DropoutEncoder(public_tokenizers.path("piece_bpe_32k.model"), 0.3, 17)
    r = random.Random(5)
    units = [b" word", b"\xe2\x96\x81", b" \xe2\x96\x81\xe2\x96\x81a", b"\n\n\t ", b"\x00", "\U0001f600 é".encode(), b"a" * m.WIDE, b" " + b"ab" * m.WIDE]
    letters = ["abcdeiorstn ", "аеиноств ", "的是不了在人有我 ", "▁ aé\U0001f600\n"]
    for _ in range(3000):
        units.append("".join(r.choices(r.choice(letters), k=r.randint(1, r.choice([4, 9, 30, m.WIDE])))).encode())
    short = [len(u) <= m.SHORT for u in units]
    variants = [r.getrandbits(60) & r.getrandbits(60) if s else r.getrandbits(63) for s in short]
    variants = [v | int(m._FIRST) * r.randint(0, 1) for v in variants]
    expected, alone = [], m.DropoutEncoder.agenda
    for u, v, s in zip(units, variants, short, strict=True):
        rest = v & int(m._FIRST) - 1
        ids, steps = alone(e, u.decode(), v != rest, rest if s else (lambda k, x=rest << 1: m._draw(x, k) < e.limit))
        expected.append([steps, *ids])
    one_by_one = []
    e.agenda = lambda unit, *rest: one_by_one.append(unit) or alone(e, unit, *rest)
    ids, sizes = e.units(units, variants)
    assert sizes.tolist() == [len(x) for x in expected]
    assert np.array_equal(ids, np.array([i for x in expected for i in x], dtype=np.uint32))
    assert one_by_one == [u.decode() for u in units if len(u.decode()) > m.WIDE]
