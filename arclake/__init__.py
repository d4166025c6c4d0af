"""arclake: game-asset archives and training-data corpora as Spark tables."""

VERSION = "0.2"
