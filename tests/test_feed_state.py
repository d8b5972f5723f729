"""What waits in a merged feed's state costs calls by blocks, not by rows."""

from __future__ import annotations

import pandas as pd

from cadenza.streaming import feeds


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class _Map:
    def __init__(self):
        self.held, self.calls = {}, 0

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.held.pop(key, None)


class _Handle:
    def getValueState(self, *_):
        return _Value()

    def getMapState(self, *_):
        return _Map()


def _page(feed, positions):
    return pd.DataFrame({"feed": feed, "position": positions, "mbid": [f"{feed}{p % 50}" for p in positions], "heard": False})


def test_waiting_rows_cost_few_calls_of_the_state():
    n = 20_000
    merge = feeds.Merge(["a", "b"], unlistened=False)
    merge.init(_Handle())
    send = lambda *pages: pd.concat(list(merge.handleInputRows((1,), iter(pages), None)))
    first = send(_page("a", range(1, n)), _page("b", range(0, n, 2)))
    assert first.empty and sum(len(v[0]) for v in merge.waiting.held.values()) == n - 1 + n // 2
    ends = pd.DataFrame({"feed": ["a", "b"], "position": [n, n], "mbid": [None, None], "heard": [None, None]})
    second = send(_page("a", [0]), _page("b", range(1, n, 2)), ends)
    assert list(second["index"]) == list(range(1, 101)) and list(second["mbid"]) == [f"{f}{p}" for p in range(50) for f in "ab"]
    assert not merge.waiting.held
    assert merge.waiting.calls + merge.shown.calls < 500
