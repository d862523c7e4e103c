"""DataFrame -> DataFrame operators over photo tables."""
