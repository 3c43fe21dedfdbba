"""Operators on listings and their history: DataFrame to DataFrame, Column to Column."""
