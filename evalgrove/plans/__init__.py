"""Views, queries and the evaluation pipeline."""
