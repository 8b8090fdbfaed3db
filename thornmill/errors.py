"""Errors of the engine. Unknown tables and columns raise Spark's AnalysisException."""


class EngineError(Exception):
    """Anything the engine itself rejects. ``code`` is the number that databases of this dialect give such errors."""

    code = 1


class SyntaxProblem(EngineError):
    """A statement that isn't understood."""


class ConstraintError(EngineError):
    """A statement whose result would break a constraint; nothing of it remains."""

    code = 19

    def __init__(self, kind: str, detail: str) -> None:
        super().__init__(f"{kind} constraint failed: {detail}")
        self.kind, self.detail = kind, detail


class TransactionError(EngineError):
    """BEGIN within a transaction, COMMIT without one, or an unknown savepoint."""
