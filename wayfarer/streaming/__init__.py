"""Streams: the search's sources are snapshots, so there is no streaming operator here; batch operators take any bounded frame of one."""
