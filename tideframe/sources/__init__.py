"""Readers and writers of bars, trades, levels, ledgers and assets."""
