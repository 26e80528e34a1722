"""Column functions: string normalisers, stop words, array and map helpers."""
