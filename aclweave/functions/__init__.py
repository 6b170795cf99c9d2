"""The condition language: parser, compiler to columns, and a plain evaluator for tests."""
