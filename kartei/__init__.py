"""Kartei: flashcard preparation, answer judging and spaced repetition on Spark DataFrames."""
