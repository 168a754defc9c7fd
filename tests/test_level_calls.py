"""Calls of the level processor on its state: each is a round trip to the JVM."""

from pyspark.sql import Row

from sparklore.streaming.jobs import LevelCompletion


class Counted:
    """Handle, value state and timer values at once; notes what is called."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def getCurrentWatermarkInMs(self):
        return 0

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append(f"register {at}")

    def deleteTimer(self, at):
        self.calls.append(f"delete {at}")


def test_levels_ask_the_state_no_more_than_needed():
    state, level = Counted(), LevelCompletion(idle_ms=100)
    level.init(state)

    def handle(*rows):
        state.calls.clear()
        out = [tuple(r) for r in level.handleInputRows(("j", "L1"), iter(rows), state)]
        return out, list(state.calls)
    two = [Row(expected=2, at_ms=5), Row(expected=2, at_ms=7)]
    assert handle(*two) == ([("j", "L1", 2, 2, "complete")], ["get"])          # whole at once: nothing to clear
    assert handle(two[1]) == ([], ["get", "register 107", "update"])
    state.value = (0, 2, 107)
    assert handle(two[0]) == ([], ["get", "update"])                           # an older unit leaves the timer as it is
    assert handle(two[1]) == ([("j", "L1", 2, 2, "complete")], ["get", "delete 107", "clear"])
