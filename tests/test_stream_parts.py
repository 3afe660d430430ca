"""Sessions of a part are worked on together: same outcomes as one by one, with a fixed number of calls to the state."""

import numpy as np
import pandas as pd

from cloakframe.streaming.steps import StepProcessor


class Value:
    def __init__(self):
        self.held, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value


class Handle:
    def getValueState(self, *_):
        self.value = Value()
        return self.value


def batches(sessions):
    rng = np.random.default_rng(4)
    for k in range(3):
        n = 60 * sessions
        yield pd.DataFrame({"session_id": np.array([f"s{i}" for i in rng.integers(0, sessions, n)], object), "step_id": rng.integers(1, 6, n),
                            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 1000, n) + 1000 * k, unit="s"), "seq": np.arange(n),
                            "op": rng.choice(["run", "success", "fail", "retry", "plan", "stop", "close", "pause"], n), "bucket": 0, "part": 0})


def test_sessions_of_a_part_equal_sessions_alone_in_few_state_calls():
    def play(parts):
        handle, processor, out = Handle(), StepProcessor(), []
        processor.init(handle)
        for part in parts:
            out += [tuple(None if pd.isna(v) else v for v in r) for table in processor.handleInputRows((0,), iter([part]), None) for r in table.itertuples(index=False)]
        return sorted(out, key=lambda r: r[3:4] + (r[0],)), handle.value.calls

    together, calls = play(batches(40))
    alone = [r for i in range(40) for r in play([b[b["session_id"] == f"s{i}"] for b in batches(40)])[0]]
    assert sorted(together, key=str) == sorted(alone, key=str) and len(together) > 7000
    assert calls == 6
