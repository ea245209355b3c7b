"""Budgeted admission and the planning cycle."""
