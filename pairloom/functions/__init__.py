"""Stateless column functions: safe on batch and streaming frames alike."""
