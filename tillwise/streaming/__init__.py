"""Live versions of the sales metrics, the stock ledger and the order audit."""
