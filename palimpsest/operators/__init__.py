"""DataFrame to DataFrame operators over versions, runs and transactions."""
