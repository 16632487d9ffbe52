from affinity.streaming.tracking import track_events

__all__ = ["track_events"]
