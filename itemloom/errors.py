"""The errors of the item API; `code` is the name a caller sees."""


class ItemError(Exception):
    code = "InternalServerError"


class ValidationError(ItemError):
    code = "ValidationException"


class ResourceNotFound(ItemError):
    code = "ResourceNotFoundException"


class ResourceInUse(ItemError):
    code = "ResourceInUseException"


class UnknownOperation(ItemError):
    code = "UnknownOperationException"


class CommitConflict(ItemError):
    code = "TransactionConflictException"


class ConditionalCheckFailed(ItemError):
    """item: the item that was found, if any."""

    code = "ConditionalCheckFailedException"

    def __init__(self, item: dict | None = None):
        super().__init__("The conditional request failed")
        self.item = item


class TransactionCanceled(ItemError):
    """reasons: one {"Code", "Message", "Item"} per request entry; only the first that failed has a code other than None."""

    code = "TransactionCanceledException"

    def __init__(self, reasons: list[dict]):
        super().__init__("Transaction cancelled: " + ", ".join(r["Code"] for r in reasons))
        self.reasons = reasons
