"""Errors that the engine raises before Spark sees a query; Spark raises its own for what it finds itself."""


class LodestarError(Exception):
    pass


class DialectSyntaxError(LodestarError):
    pass


class UnsupportedFeature(LodestarError):
    pass


class PlanningError(LodestarError):
    pass


class FlatTableJoin(PlanningError):
    pass


class CrossDatabaseJoin(PlanningError):
    pass


class InvalidExpand(PlanningError):
    pass


class ViewAsNotAllowed(PlanningError):
    pass


class InvalidAggregateUsage(PlanningError):
    pass


class TableNotFound(LodestarError):
    pass


class TypeNotFound(LodestarError):
    pass


class TypeExists(LodestarError):
    pass


class ColumnNotFound(LodestarError):
    pass


class TypeInUse(LodestarError):
    pass


class InvalidEnumValue(LodestarError):
    pass


class ConstraintViolation(LodestarError):
    pass


class NullConstraintViolation(ConstraintViolation):
    pass


class ReferentialIntegrityViolation(ConstraintViolation):
    pass


class PermissionDenied(LodestarError):
    pass


class TransactionError(LodestarError):
    pass
