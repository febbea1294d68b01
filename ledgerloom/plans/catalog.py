"""All registered queries."""

from ledgerloom.plans import checking, feeding, generating, imitating, trading

REGISTERS = (generating.register, imitating.register, checking.register, trading.register, feeding.register)

flagship = trading.order_slice
