"""Readers of Kotlin, Java and XML text: one file in, rows of facts out."""
