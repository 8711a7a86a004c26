"""The same operators over arriving files (an addition to what is asked of the batch engine)."""
