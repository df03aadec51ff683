"""Operators over metric and feature tables."""
