"""DataFrame operators over panels of price bars."""
