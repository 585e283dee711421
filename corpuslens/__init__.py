"""corpuslens: security analytics over source corpora and review runs, as Spark jobs."""

__version__ = "0.1.0"
