"""Audit streams keep the events of many keys in one state."""

import pandas as pd

from corpusmill.streaming.keyed import TokenBucket, _Audit


class Handle:
    """State as plain values; every call of it is counted."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def _state(self, *_):
        return State(self)

    getListState = getMapState = getValueState = _state

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)


class State:
    def __init__(self, handle):
        self.handle, self.rows, self.value, self.map = handle, [], None, {}

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "clear", "appendValue", "appendList", "containsKey", "getValue", "updateValue"):
            object.__getattribute__(self, "handle").calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return object.__getattribute__(self, "value") is not None

    def get(self):
        return self.value if object.__getattribute__(self, "value") is not None else iter(list(self.rows))

    def update(self, value):
        self.value = value

    def clear(self):
        self.value, self.rows = None, []

    def appendValue(self, row):
        self.rows.append(row)

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_of_state_do_not_grow_with_the_keys_of_a_batch():
    handle, audit = Handle(), _Audit(TokenBucket(0.001, 2, 1e9))
    audit.init(handle)
    events = pd.DataFrame({"key": [f"k{i % 500}" for i in range(3000)], "event_id": range(3000), "ts": pd.to_datetime([i * 1_000_000 for i in range(3000)], unit="us"), "ok": True})
    for part in (events[1::2], events[::2]):
        list(audit.handleInputRows((3,), iter([part]), None))
    assert handle.calls <= 20
    # A watermark in the middle leaves later events and one timer; the rest comes with the next one.
    got = [*audit.handleExpiredTimer((3,), Watermark(1_200_000), None)]
    assert max(handle.timers) == 1_201_000
    got = pd.concat([*got, *audit.handleExpiredTimer((3,), Watermark(9_000_000), None)]).sort_values("event_id")
    assert got["event_id"].tolist() == list(range(3000))
    want, states, machine = [], {}, TokenBucket(0.001, 2, 1e9)
    for k, i in zip(events["key"], range(3000)):
        states[k], verdict = machine.step(states.get(k, machine.fresh()), float(i), True)
        want.append(verdict)
    assert got["verdict"].tolist() == want and len(set(want)) == 2
