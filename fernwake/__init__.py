"""fernwake: analytics for labelled, subject-grouped time-window tables on Spark."""

__version__ = "0.1.0"
