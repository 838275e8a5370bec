"""tenor: Spark-native yearly discourse analysis.

Landed video/comment pages are flattened, sampled and capped per year and per
video, filtered by language and content, scored with lexicon tables and keyword
flags, classified with Spark ML over sliding word windows, merged across two
models by id, evaluated on a stratified held-out split, and published as
year-level aggregates. Every step is a DataFrame -> DataFrame function.
"""

from tenor.session import build_session, tune

__all__ = ["build_session", "tune"]
