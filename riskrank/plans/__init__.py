"""The whole review, from raw inputs to the champion decision."""
