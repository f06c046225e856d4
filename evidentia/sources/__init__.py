"""Readers that turn raw text columns into tables."""
