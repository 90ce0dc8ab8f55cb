"""Typed refusals."""


class Refusal(Exception):
    """A program, value or budget the engine declines."""


class ParseError(Refusal):
    pass


class UnsafeRule(Refusal):
    """A variable that nothing binds."""


class NotStratifiable(Refusal):
    """Negation or plain aggregation through recursion."""


class UnknownName(Refusal):
    pass


class TypeRefusal(Refusal):
    pass


class LimitExceeded(Refusal):
    pass


class WriteRefusal(Refusal):
    """A mutation whose preconditions fail."""
