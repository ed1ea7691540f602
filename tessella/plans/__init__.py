"""Query plans put together from operators."""
