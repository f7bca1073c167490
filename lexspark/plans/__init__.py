"""Named queries. Importing the package registers those of all its modules in the catalogue."""

from lexspark.plans import arabic, assistant, catalogue, loading, questions, schedules, shelves

__all__ = ["arabic", "assistant", "catalogue", "loading", "questions", "schedules", "shelves"]
