"""Conversation and speaker analytics as Spark DataFrame operators."""
