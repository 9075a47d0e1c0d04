"""The memory of a group in one task is that of the passes over features; one pass summarises candidates."""

import numpy as np
import pytest

from spark_analog.operators import memory, retrieve, windows

L, H = 8, 2


@pytest.fixture(scope="module")
def blocked(spark):
    rng = np.random.default_rng(3)
    rows = [(e, "memory", 0, c, 0, 60, t, float(rng.normal())) for e in ("a", "b") for c in ("x", "y") for t in range(60)]
    steps = spark.createDataFrame(rows, "entity string, role string, segment long, channel string, start long, "
                                        "length long, t long, value double")
    return windows.blocks(steps, L, H, block=16).localCheckpoint()


@pytest.mark.parametrize("selection", ["uniform", "farthest", "boundary"])
def test_a_group_in_one_task_gives_the_same_bank(blocked, selection):
    def read(bank, scales):
        bank = bank.select("entity", "channel", "slot", "src_w", "feat", "delta").collect()
        return ({tuple(r[:4]): list(r.feat) + list(r.delta) for r in bank},
                {tuple(r[:2]): list(r.center) + list(r.scale) for r in scales.collect()})

    wide = read(*memory.build_bank(windows.scan(blocked, L, H, features=True), 10, selection))
    for got in (read(*memory.build_block_bank(blocked, L, H, 10, selection, most=60)),
                read(*memory.build_bank(windows.scan(blocked, L, H, features=True), 10, selection, most=60))):
        for one, other in zip(got, wide):
            assert one.keys() == other.keys() and len(one) in (40, 4)
            for k in one:
                assert one[k] == pytest.approx(other[k], rel=1e-12, abs=1e-12)


def test_candidates_are_summarised_in_one_python_pass(blocked, capsys):
    bank = memory.pack_bank(*memory.build_block_bank(blocked, L, H, 10, most=60))
    seen = retrieve.summarise(windows.scan(blocked, L, H, bank=bank, k=3), H)
    seen.explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(" not in plan


def test_windows_of_many_short_blocks_leave_a_task_together(blocked, monkeypatch):
    """One batch for all blocks of a task, and the rows that every block gives on its own."""
    seen, plain = {}, type(blocked).mapInArrow
    bank = memory.pack_bank(*memory.build_block_bank(blocked.where("entity = 'a' or channel = 'x'"), L, H, 10, most=60))

    def keep(frame, run, schema):
        seen.update(run=run, given=frame.toArrow())
        return plain(frame, run, schema)

    monkeypatch.setattr(type(blocked), "mapInArrow", keep)
    windows.scan(blocked, L, H, bank=bank, k=3, features=True, contexts=True)
    given = seen["given"]
    whole = list(seen["run"](iter(given.to_batches())))
    alone = [b for i in range(given.num_rows) for b in seen["run"](iter(given.slice(i, 1).to_batches()))]
    assert given.num_rows == 16 and len(whole) == 1 and len(alone) == 16
    pairs = list(zip(whole[0].to_pylist(), (r for b in alone for r in b.to_pylist()), strict=True))
    assert len(pairs) == 4 * (60 - L - H + 1) and {len(one["candidates"]) for one, _ in pairs} == {0, 3}
    for one, other in pairs:
        assert one.pop("feat") == pytest.approx(other.pop("feat"), rel=1e-12, abs=1e-12)
        near, far = one.pop("candidates"), other.pop("candidates")
        assert [(c["rank"], c["src_w"]) for c in near] == [(c["rank"], c["src_w"]) for c in far]
        for c, o in zip(near, far):
            assert [c["distance"], *c["future"]] == pytest.approx([o["distance"], *o["future"]], abs=1e-8)
        assert one == other
