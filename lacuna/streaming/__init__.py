"""Extensions beyond the batch studies: sessions and availability-time features of event streams."""
